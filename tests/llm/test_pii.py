"""Personal data in messages."""

import pytest

from graphmill.llm import pii as P

FAMILIES = ["Godribradatt", "Zikanenar", "Sogilebar", "Vesedibok", "Lidragoden", "Fapavidrom", "Klidrabre", "Momizetim", "Zegazegor", "Brakebrasak"]
GIVENS = ["Samantha", "Arjun", "Priya", "Dmitri", "Alexander", "Robert", "Imani"]
GIVEN_TABLE = [(g,) for g in GIVENS]


def texts(spark, rows):
    return spark.createDataFrame([("t", "body", i, t, "x") for i, t in enumerate(rows)], "src_table string, src_field string, record_id long, text string, start string")


CORPUS = [f"reported by {g} {f}" for g, f in zip(GIVENS, FAMILIES)] + [f"call {n} when the job fails" for n in ("+49 30 555 18 05", "+1-555-0187-758", "0049-30-5558888", "(555) 012-2766")] + [f"mask {n} before export" for n in ("passport G56QJXDEX", "DNI 67467894W", "SSN 920-32-2625")]
NEW = ["reported by Hiroko Tolerekal", "thanks, reported by samantha votitizol", "call 0368/555 1670 when the job fails", "mask 989-14-9455 before export", "mail ann@lab.test or bo (at) lab (dot) test", "returns go to Calle del Olmo 184, 2ºB, 12453 Valcourt now", "parcel for 12 Kestrel Avenue, Brackwater 47518"]
DECOYS = ["Victoria Sponge Tin has no unit price", "price of Robert Lamp is zero", "order 65525-65525 counted twice", "sku 55501083984412", "clone from git@codehost.example:lab/x.git", "thanks @basketcase", "pins modelstore@7.25.6 again", "12 Lane pipeline now uses 3 Street View tiles", "host 10.0.217.217 timed out", "epoch 1700443358459", "build 2024-01-11 64823955"]


@pytest.fixture(scope="module")
def found(spark):
    df = texts(spark, [*CORPUS, *NEW, *DECOYS, None, "", "x" * 200_000])
    given = spark.createDataFrame(GIVEN_TABLE, "given string")
    return df, P.find_mentions(df, given).persist()


def test_finds(found):
    df, mentions = found
    all_ = [*CORPUS, *NEW, *DECOYS]
    got = {}
    for r in mentions.collect():
        got.setdefault(r["record_id"], []).append((r["pii_type"], all_[r["record_id"]][r["start"] : r["stop"]]))
    at = len(CORPUS)
    assert [t for i in range(len(GIVENS)) for t, _ in got[i]] == ["person_name"] * len(GIVENS)
    assert got[at] == [("person_name", "Hiroko Tolerekal")] and got[at + 1] == [("person_name", "samantha votitizol")]
    assert got[at + 2] == [("phone", "0368/555 1670")] and got[at + 3] == [("id_number", "989-14-9455")]
    assert [t for t, _ in sorted(got[at + 4], key=lambda x: x[1])] == ["email", "email"]
    assert got[at + 5][0] == ("address", "Calle del Olmo 184, 2ºB, 12453 Valcourt") and got[at + 6][0][0] == "address"
    decoys = range(len(CORPUS) + len(NEW), len(all_) + 3)
    assert not [got[i] for i in decoys if i in got]


def test_occurrence_and_redaction(found):
    df, mentions = found
    at = len(CORPUS) + 4
    assert sorted(r["occurrence"] for r in mentions.where(f"record_id = {at}").collect()) == [1, 2]
    text = {r["record_id"]: r["text"] for r in P.redact_texts(df, mentions).collect()}
    assert text[at] == "mail [EMAIL] or [EMAIL]" and text[0] == "reported by [PERSON_NAME]"
    assert text[at + 3 + 0].startswith("Victoria") or text[len(CORPUS) + len(NEW)] == DECOYS[0]
    assert text[len(CORPUS) + len(NEW) + len(DECOYS)] is None and len(text) == df.count()


def test_empty(spark):
    given = spark.createDataFrame(GIVEN_TABLE, "given string")
    assert P.find_mentions(texts(spark, []), given).count() == 0
    assert P.find_mentions(texts(spark, [None, ""]), given).count() == 0
    assert P.find_mentions(texts(spark, ["a@lab.test"]), given.limit(0)).count() == 1


LOOSE = ["parcel went to Brackwater, 12 Kestrel Avenue today", "parcel went to 9 Copper Lane in Osthaven today", "parcel went to 31 Harrow Road Lowmere today", "contact zo.hobor at lab punkt test for access", "contact mia_kelt [ät] kiosk.invalid for access"]
LOOSE_DECOYS = ["12 Lane pipeline uses 3 Street View In Osthaven again", "look at main.py for details", "release 12 Kestrel Avenue in Beta form"]


def test_looser_addresses_by_trusted_patterns(spark):
    backing = [f"parcel went to {n} Orchard Street, {t} 4821{n} today" for n, t in enumerate(("Pinemouth", "Valcourt", "Easterby", "Torrelago", "Nordhalden", "Saint-Orvan"), 1)] + [f"contact {n}@lab.test for access" for n in ("ann", "bo", "cy", "dee")]
    rows = [*backing, *LOOSE, *LOOSE_DECOYS]
    got = {r["record_id"]: (r["pii_type"], rows[r["record_id"]][r["start"] : r["stop"]]) for r in P.find_mentions(texts(spark, rows), spark.createDataFrame(GIVEN_TABLE, "given string")).collect()}
    at = len(backing)
    assert [got.get(at + i) for i in range(len(LOOSE))] == [("address", "Brackwater, 12 Kestrel Avenue"), ("address", "9 Copper Lane in Osthaven"), ("address", "31 Harrow Road Lowmere"), ("email", "zo.hobor at lab punkt test"), ("email", "mia_kelt [ät] kiosk.invalid")]
    assert not [got[i] for i in range(at + len(LOOSE), len(rows)) if i in got]


def test_short_family_names_and_far_context(spark):
    rows = [*CORPUS, "reported by Wei Li", "reported by Hao Wu", "reported  by" + " " * 300 + "Imani Su"]
    got = {r["record_id"]: rows[r["record_id"]][r["start"] : r["stop"]] for r in P.find_mentions(texts(spark, rows), spark.createDataFrame(GIVEN_TABLE, "given string")).collect()}
    assert [got.get(len(CORPUS) + i) for i in range(3)] == ["Wei Li", "Hao Wu", "Imani Su"]


def test_seeded_forms_are_outvoted_by_their_patterns(spark):
    """A phone-like number in a place that holds all sorts of other numbers is no find, elsewhere it is."""
    rows = [f"stock item {n} left over" for n in ("4455-1122-9", "77 12345 88", "123456789", "AB123456", "12-345-678", "99/88/77665", "4455 12.34 5", "7.654.321 0", "1234567-8")] + ["stock item +49 30 555 18 05 left over", "call +49 30 555 18 05 when it fails"]
    got = {r["record_id"] for r in P.find_mentions(texts(spark, rows), spark.createDataFrame(GIVEN_TABLE, "given string")).collect()}
    assert got == {len(rows) - 1}


def test_small_names_by_filter_and_join(spark):
    df = texts(spark, ["thanks to robert zikanenar and imani klidrabre", "nothing here at all"])
    given = spark.createDataFrame([("robert",), ("imani",)], "told string")
    plain = sorted(map(tuple, P.find_small_names(df, given).select("record_id", "start", "instance").collect()))
    assert plain and sorted(map(tuple, P.find_small_names(df, given, most_names=1).select("record_id", "start", "instance").collect())) == plain
