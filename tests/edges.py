"""Tables that are empty, and tables with repeats and a null in every column once."""

import pyarrow as pa
import pyarrow.parquet as pq

from tests.oracle import DATA


def write(folder):
    for kind in ("empty", "nulls"):
        (folder / kind).mkdir()
    for f in DATA.glob("*.parquet"):
        t = pq.read_table(f)
        pq.write_table(t.slice(0, 0), folder / "empty" / f.name)
        parts = [t.slice(0, 40), t.slice(0, 5), pa.table({c.name: pa.nulls(3, c.type) for c in t.schema}, schema=t.schema)]
        parts += [t.slice(i % t.num_rows, 1).set_column(i, c, pa.nulls(1, c.type)).cast(t.schema) for i, c in enumerate(t.schema)]
        pq.write_table(pa.concat_tables(parts), folder / "nulls" / f.name)
    return folder
