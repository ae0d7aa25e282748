"""Personal information in texts of other kinds than the tables': names of many languages, numbers of other states, and look-alikes."""

import pytest

from framewright.llm import pii, pii_spans

#: What stands between | | is a spot of the type before the colon.
LINES = """The lease was countersigned by |name:Nguyen Thi Mai| on Tuesday.
Minutes written by |name:Oluwaseun Adeyemi|, approved without changes.
We are grateful to Dr |name:Svetlana Kuznetsova| for her time.
Please forward the folder to Mr |name:Kwame Mensah| before noon.
Interview with |name:Priyanka Chopra| about the renovation.
Photographed by |name:Rajesh Patel|, spring edition.
Kind regards, |name:Wei Zhang|
Der Bericht wurde von |name:Jürgen von der Heide| unterschrieben.
Entretien avec |name:Françoise Lemaire|, adjointe au maire.
El acta la firmó |name:Lucía Ibarra de la Torre| ayer.
Signed by |name:Giovanni Esposito| in blue ink.
Sprecher: |name:Anneliese Brandt|
Dear |name:Mohammed Farouk|, the parcel has arrived.
Her mail is |email:k.mensah+work@uni-lab.example| until May.
Schreiben Sie an |email:anna_b at kanzlei punkt example| oder kommen Sie vorbei.
Write to |email:rajesh (at) shop (dot) example (dot) net| for spares.
Ruf mich an unter |phone:0171 2345678|, gern abends.
Call |phone:044 668 18 00| for the workshop.
The hotline is +|phone:91 98765 43210| on weekdays.
Ligue para (|phone:11) 91234-5678| depois das nove.
Tel. +|phone:33 1 45 67 89 01|, laissez un message.
Her number is |phone:020 7946 0958| at the office.
CPF |id_number:529.982.247-25| foi conferido.
National insurance number |id_number:AB 12 34 56 C| was on the slip.
Passport no. |id_number:L8390274| expires soon.
SSN |id_number:219-09-9999| appears on page two.
Codice fiscale |id_number:RSSMRA85T10A562S| verificato.
DNI |id_number:12345678Z| en la copia.
Abita in |address:Via Roma 12| dal 2019.
Mieszka przy |address:ul. Marszałkowska 10| od roku.
She lives at |address:48b Elm Street| with two cats.
Wohnhaft in |address:Lindenallee 7| seit Mai.
Deliver the lamp to |address:Flat 3, 19 Harbour Road| please.
Habite au |address:14 rue de la Paix| depuis un an.
Vive en |address:Calle Mayor 25| desde enero.
The ferry to Green Island leaves at 9:15 from Pier 4.
IBAN DE89 3704 0044 0532 0130 00 belongs to the club.
Invoice 20394857 covers 3 hours and 20 minutes.
Order 555-0199-22 was shipped in 2 boxes.
Oak Ridge Museum opens on Monday, and Harbour Bridge stays shut.
Ticket 4929 1234 5678 is void.
The River Avenue exhibition drew 12500 visitors.
Version 10.4.2 runs at 60 fps on Sunset Express.
Meet at the corner of Market Street after lunch.
Checksum 9834751203 differs from build 77120345.
See the handle @harbourlights and photo@2x.png for details.
New Year Market closes early, says the notice.""".split("\n")


def _parse(line: str) -> tuple[str, list[tuple[str, int]]]:
    text, spots = "", []
    for i, part in enumerate(line.split("|")):
        if i % 2:
            kind, part = part.split(":", 1)
            spots.append((kind, len(text)))
        text += part
    return text, spots


def test_held_out_texts(spark):
    parsed = [_parse(x) for x in LINES]
    rows = [(i + 100 * copy, t) for copy in range(4) for i, (t, _) in enumerate(parsed)]
    found = {(r.doc % 100, r.pii_type, r.start_pos) for r in pii.detect(spark.createDataFrame(rows, "doc long, text string"), "doc", "text").collect()}
    true = {(i, k, at) for i, (_, spots) in enumerate(parsed) for k, at in spots}
    recall, precision = len(found & true) / len(true), len(found & true) / max(1, len(found))
    assert recall >= 0.9 and precision >= 0.9, (recall, precision, sorted(true - found), sorted(found - true))


@pytest.mark.parametrize("number, good", [("52998224725", True), ("52998224726", False), ("12345678Z", True), ("12345678A", False), ("X1234567L", True), ("236412341234", True), ("236412341235", False)])
def test_check_digits(number, good):
    assert pii_spans.checked_number(number) is good and pii_spans._verhoeff("2363") and not pii_spans._verhoeff("2364")


def test_reliabilities_follow_the_counts():
    # A labeler that mostly votes where others vote against it loses its weight.
    m = pii.VoteModel({"a=name b=name": 900, "b=none c=name d=none": 600, "a=name": 50, "c=name": 40, "c=name d=none": 300})
    assert m.probability("a=name") > 0.9 and m.probability("c=name d=none") < 0.5


def test_common_words_and_phrases(spark):
    rows = [(i, f"Copper Kettle serves tea {i}. Signed by Wei Zhang.") for i in range(40)]
    df = spark.createDataFrame(rows, "doc long, text string")
    assert {"serves", "tea"} <= pii.common_words(df, "text")
    spots = pii.find_spots(df, "doc", "text")
    assert pii.fixed_phrases(spots) == {"copper kettle"}
    assert {r.start_pos for r in pii.detect(df, "doc", "text").where("doc = 20").collect()} == {rows[20][1].index("Wei")}
