import datetime as dt

from pyspark.sql import functions as F

from postlake.sinks.contacts import phone_columns, vcard, write_cards
from postlake.sources import vcards

FIELDS = ["display_name", "surname", "given", "middle", "prefix", "suffix", "nickname", "company", "department", "title", "profession"]
SCHEMA = ", ".join(f"{f} string" for f in FIELDS) + ", phones array<struct<kind:string,number:string>>, emails array<string>, birthday date, categories array<string>, notes string"
ROWS = [
    ("Ada Lovelace", "Lovelace", "Ada", "King", "Lady", "I", "Enchantress", "Engines, Ltd; north", "Number\\theory", "Countess", "Mathematician", [("work", "1"), ("home", "2"), ("work", "3"), ("work,fax", "4"), ("cell", "+44 5;6"), ("pager", "7")], ["ada@example.org", "countess@example.net"], dt.date(1815, 12, 10), ["Science", "VI,P", "a\\b"], "first line\nEND:VCARD in a note; with, marks: and \\n text " + "Prüfung naïve 日本語 " * 12),
    ("Bob", "", "", "", "", "", "", "", "", "", "", [], ["b@example.com"], None, [], ""),
    ("x", "a;b", "c\\", "\\;d", "", "", "", "", "only department", "", "", [("pref", "9")], [], dt.date(2000, 2, 29), ["one"], "\n\nends with blank lines\n\n"),
]


def cards(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select(vcard({c: F.col(c) for c in df.columns}, revision=F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")).alias("card"))


def test_cards_read_back(spark, tmp_path):
    want = [(*r[:11], r[11], r[12], r[13], r[14], r[15]) for r in ROWS]

    def plain(rows):
        return sorted([(*[r[f] for f in FIELDS], [(p["kind"], p["number"]) for p in r["phones"]], r["emails"], r["birthday"], r["categories"], r["notes"]) for r in rows])

    assert plain(cards(spark).select(vcards.contact(F.col("card")).alias("c")).select("c.*").collect()) == sorted(want)
    write_cards(cards(spark), f"{tmp_path}/cards")
    assert plain(vcards.read_cards(spark, f"{tmp_path}/cards").select(vcards.contact(F.col("card")).alias("c")).select("c.*").collect()) == sorted(want)


def test_cards_of_other_writers(spark):
    text = "BEGIN:VCARD\nVERSION:2.1\nitem1.TEL;WORK;VOICE:1\nTEL;type=CELL;TYPE=pref:2\nfn:Some\n  one\nemail;X=\"a:b\":e@x.y\nBDAY:19900510\nADR:;;x\nEND:VCARD"
    c = spark.createDataFrame([(text,), ("",), (None,), ("no card",)], "card string").select(vcards.contact(F.col("card")).alias("c")).collect()
    first = c[0]["c"]
    assert [(p["kind"], p["number"]) for p in first["phones"]] == [("work,voice", "1"), ("cell", "2")] and first["display_name"] == "Some one" and first["emails"] == ["e@x.y"] and first["birthday"] == dt.date(1990, 5, 10)
    assert all(r["c"]["display_name"] == "" and r["c"]["phones"] == [] for r in c[1:2]) and c[3]["c"]["emails"] == []


def test_phones_fill_the_table(spark):
    found = cards(spark).select(vcards.contact(F.col("card")).alias("c")).where("c.surname = 'Lovelace'")
    r = found.select(*[p.alias(k) for k, p in phone_columns(F.col("c.phones")).items()]).first()
    assert (r["business_phone"], r["business_phone2"], r["home_phone"], r["business_fax"], r["mobile_phone"], r["pager"], r["home_phone2"]) == ("1", "3", "2", "4", "+44 5;6", "7", "")


def test_cards_of_one_small_file_are_many_tasks(spark, small):
    from postlake.plans import queries as mail

    assert mail.table(spark, small, "customer").rdd.getNumPartitions() == 1
    assert mail.queries()["contacts_read"](spark, small).rdd.getNumPartitions() >= 8
