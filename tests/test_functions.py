import zlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import lists, measures, text, urls


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "f, value, want",
    [
        (text.mask_digits, "12 of 345", "DPNUM of DPNUM"),
        (text.strip_spaces, " \ta ", "\ta"),
        (text.strip_whitespace, " \ta\n ", "a"),
        (text.one_line, "a\nb\rc", "a bc"),
        (text.without_breaks, "a\nb\tc\r", "abc"),
        (text.digits_only, "a1b22", "122"),
        (text.squeezed, "a \n b", "a b"),
        (text.latin1_only, "aé日", "aé"),
        (text.printable_ascii, "aé\x01b\t", "ab\t"),
        (text.line_count, "a\n\nb", 3),
        (text.longest_digit_run, "1 22 x 333", 3),
        (text.longest_digit_run, "none", 0),
        (text.file_name, "http://a.b/c?d=é", "httpa.bcdé"),
        (text.nfkd_ascii, "Élan ﬁn", "Elan fin"),
        (text.tabs_expanded, "a\tb", "a       b"),
        (urls.hostname, "http://u:p@WWW.Ex.com:80/a", "www.ex.com"),
        (urls.netloc, "http://u:p@WWW.Ex.com:80/a", "u:p@WWW.Ex.com:80"),
        (urls.hostname, "not a url", None),
        (urls.base_url, "https://a.b/c?d#e", "a.b/c"),
        (urls.strip_www_letters, "www.wa.com", "a.com"),
        (urls.glued_path, "http://a.b/p;x?q=1#f", "/pxq=1f"),
        (urls.registrable_domain, "a.b.example.org", "example.org"),
        (urls.registrable_domain, "10.0.0.1", "10.0.0.1"),
        (urls.registrable_domain, "localhost", None),
    ],
)
def test_text_and_urls(spark, f, value, want):
    assert one(spark, value, f) == want


def test_two_label_suffixes(spark):
    assert one(spark, "a.shop.co.uk", lambda c: urls.registrable_domain(c, ["co.uk"])) == "shop.co.uk"
    assert one(spark, "co.uk", lambda c: urls.registrable_domain(c, ["co.uk"])) is None


def test_signed_crc_hex(spark):
    for s in ("http://a", "http://b/c", "x"):
        v = zlib.crc32(s.encode())
        signed = v - (1 << 32) if v >> 31 else v
        assert one(spark, s, text.unsigned_hex_of_signed_crc) == f"{abs(signed):x}"


def test_product_id_lengths(spark):
    for path, want in (("/p/123", 0), ("/p/1234", 1), ("/p/" + "1" * 32, 0), ("/p/" + "1" * 31, 1)):
        assert one(spark, path, lambda c: text.has_run_between(c, 3, 32)) == want


def test_digit_numbers_are_capped(spark):
    assert int(one(spark, "a0012b3", text.digits_number)) == 123
    assert one(spark, "9" * 39, text.digits_number) is None and one(spark, "none", text.digits_number) is None


def test_all_caps(spark):
    for w, want in (("BUY2", True), ("Buy", False), ("64", False)):
        assert one(spark, w, text.all_caps) is want


def test_right_closed_bins(spark):
    for v, want in ((10000.0, 1), (10001.0, 2), (0.0, None), (400001.0, None), (400000.0, 40)):
        assert one(spark, v, lambda c: measures.right_closed_bin(c, 10000, 40), "double") == want


def test_ratio_and_cosine(spark):
    row = spark.range(1).select(measures.ratio(F.lit(1), F.lit(0)).alias("r"), measures.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0))).alias("c"), measures.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z")).first()
    assert (row.r, row.c, row.z) == (-1.0, 1.0, 0.0)


def test_third_party_is_three_valued(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "b")], "x string, y string").select(urls.third_party(F.col("x"), F.col("y")).alias("t")).collect()
    assert [r.t for r in rows] == [False, True, None]


def test_resolved(spark):
    page = "http://shop.example.com/a"
    for href, want in (("/b", "http://shop.example.com/b"), ("//x.example.com/c", "http://x.example.com/c"), ("http://other.org/", None), ("mailto:a", None), ("https://example.com/\n", "https://example.com/")):
        assert one(spark, href, lambda c: urls.resolved(c, F.lit(page))) == want


# Examples of the published algorithm.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "sing": "sing", "conflated": "conflat", "sized": "size",
    "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam",
    "operator": "oper", "sensibiliti": "sensibl", "triplicate": "triplic", "goodness": "good", "replacement": "replac", "adoption": "adopt", "rate": "rate", "cease": "ceas", "controll": "control",
    "roll": "roll", "generalizations": "gener", "is": "is", "": "",
    # the extensions
    "buy": "buy", "day": "day", "pay": "pay", "today": "today", "play": "play", "display": "display", "news": "news", "dying": "die", "dies": "die", "flies": "fli", "mules": "mule", "denied": "deni", "died": "die",
    "owned": "own", "humbled": "humbl", "meeting": "meet", "stating": "state", "siezing": "siez", "itemization": "item", "sensational": "sensat", "traditional": "tradit", "reference": "refer", "colonizer": "colon", "plotted": "plot",
    "cry": "cri", "by": "by", "enjoy": "enjoy", "possibly": "possibl", "geology": "geolog", "hopefully": "hope", "proceed": "proceed", "skies": "sky", "cried": "cri", "nationally": "nation",
}


def test_stemmer(spark):
    got = spark.createDataFrame([(list(STEMS),), (None,)], "w array<string>").select(text.stemmed("w").alias("s")).collect()
    assert dict(zip(STEMS, got[0].s)) == STEMS and got[1].s is None


def test_tokens(spark):
    said = "The Ponies are 42 hopping,\tcaf\u00e9 x9 operators"
    rows = spark.createDataFrame([(said,), (None,)], "t string").select(text.tokens(F.col("t"), ["the", "are"]).alias("t"), text.ascii_tokens(F.col("t")).alias("a"), text.normalised(F.col("t"), ["the"], stem=True).alias("n")).collect()
    assert rows[0].a == ["the", "poni", "are", "hop", "caf", "x9", "oper"]
    assert rows[0].t[:2] == ["poni", "hop"] and rows[0].t[-2:] == ["x9", "oper"]
    assert rows[0].n == "poni are dpnum hop caf xdpnum oper" and (rows[1].t, rows[1].a, rows[1].n) == ([], [], None)


def test_escapes_and_suffixes(spark):
    assert one(spark, "a\tb\nc\\d\r", text.escaped) == "a\\tb\\nc\\\\d\\r"
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": (None, "co.uk"), "x.y.com": ("y.com", "com"), "1.2.3.4": ("1.2.3.4", None), "bare": (None, "bare")}
    for host, (domain, suffix) in hosts.items():
        assert (one(spark, host, urls.registrable_domain), one(spark, host, urls.public_suffix)) == (domain, suffix)
    assert one(spark, "a.org/x", urls.with_scheme) == "http://a.org/x" and one(spark, "https://a.org", urls.with_scheme) == "https://a.org"


def test_lists(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, []), (3, None)], "id int, x array<string>")
    rows = {r.id: r for r in df.select("id", lists.tuples(F.col("x"), 3, F.lit("-")).alias("t"), lists.random_subarray(F.col("x"), 2).alias("r"), lists.deep_flatten(F.array(F.array("x"), F.array("x")), 2).alias("f")).collect()}
    assert rows[1].t == [["a", "b", "c"], ["d", "-", "-"]] and len(set(rows[1].r) & set("abcd")) == 2 and rows[1].f == list("abcdabcd")
    assert (rows[2].t, rows[2].r, rows[2].f) == ([], [], []) and (rows[3].r, rows[3].f) == (None, [])


def test_colours_and_rectangles(spark):
    row = spark.range(1).select(measures.colour_distance(F.lit("rgb(0, 0, 0)"), F.lit("rgba(3, 4, 0, 1)")).alias("d"), measures.rectangles_meet(*(F.lit(v) for v in (0, 0, 2, 2, 1, 1, 5, 5))).alias("m"), measures.rectangles_meet(*(F.lit(v) for v in (0, 0, 1, 1, 1, 1, 5, 5))).alias("n")).first()
    assert (row.d, row.m, row.n) == (5.0, True, False)
