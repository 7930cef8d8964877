"""Personal data: the base against plain code, the selection on examples that weren't fitted to, odd texts."""

import hashlib
import random
import re
import time

import pytest

from tidewatch.llm import personal_data, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_of(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    checks = [("email", EMAIL, lambda s: True), ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))), ("card", CARD, lambda s: luhn(digits(s))), ("phone", PHONE, lambda s: 9 <= len(digits(s)) <= 15)]
    return sorted(((m.start(), k, m.end(), kind) for k, (kind, pattern, good) in enumerate(checks) for m in pattern.finditer(text or "") if good(m[0])))


@pytest.fixture(scope="module")
def model(spark):
    return personal_data.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def check_base(rows, texts):
    for row, text in zip(rows, texts, strict=True):
        base = base_of(text)
        written = ",".join(f"{kind}:{a}:{z}" for a, _, z, kind in base)
        assert [row[f"n_{k}"] for k in personal_data.BASE_KINDS] == [sum(x[3] == k for x in base) for k in personal_data.BASE_KINDS], text
        assert row.base_sha256 == hashlib.sha256(written.encode()).hexdigest(), (text, written, row.spans)
        spans = row.spans.split(",") if row.spans else []
        assert [s for s in spans if s in written.split(",")] == (written.split(",") if written else [])
        order = [(int(s.split(":")[1]), personal_data.KINDS.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)


def test_query_over_whole_texts(spark, model):
    docs = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), key=lambda r: r.doc_id)
    rows = sorted(queries.op13_personal_data(spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs]
    check_base(rows, [d.text for d in docs])
    for d, r in zip(docs, rows, strict=True):  # the secrets in these texts are found, and nothing else in texts without marks of any
        secret = [(m.start(1), m.end(1)) for m in re.finditer(r'token = "([0-9a-f]{40})"', d.text)]
        assert {f"secret:{a}:{z}" for a, z in secret} <= set(r.spans.split(","))
        if not re.search(r"[0-9@+:=\[(]", d.text):
            assert r.spans == ""


def test_base_on_random_and_odd_texts(spark, model):
    rng = random.Random(9)
    pieces = ["a", "Z", "_", ".", "-", "+", "@", " ", "  ", "1", "23", "456", "255", "256", "007", "4111111111111111", "(", ")", "é", "漢", "👍", "\n", "\t", "%", "a.b@c.de", "1.2.3.4", "+1 (555) 123-4567"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["x@y.z_d@e.f", "a@b.c.d.@e.f", "1.2.3.4.5.6.7.8.9", "0000000001.2.3.000255", "1.2.3.99999999999999999999", "a@b@c.d", "@a.b", "4111 1111-1111 1111 ", "4465758382889437 4465758382889437", "+1-2", "+12 " + "3" * 30]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows = sorted(personal_data.report(frame, model).collect(), key=lambda r: r.doc_id)
    check_base(rows, texts)
    assert rows[texts.index("4465758382889437 4465758382889437")].spans == "card:0:16,card:17:33"


def test_very_long_texts_take_time_in_proportion(spark, model):
    """Runs in which a backtracking pattern would take the square of the length; the short ones stand for the long in plain code."""
    forms = ["a", "1", "1 ", "1.", "a@", "+", "(", "=", "1:", "A1B2", "password=", "DE12 ", "4111111111111111, ", "x@b.c "]
    texts = [f * (200_000 // len(f)) for f in forms] + ["a." * 100_000 + "@", "x@" + "b." * 100_000, "+1" + " " * 200_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    began = time.perf_counter()
    rows = {r.doc_id: r for r in personal_data.report(frame, model).collect()}
    assert time.perf_counter() - began < 60
    assert rows[forms.index("4111111111111111, ")].n_card == 200_000 // 18
    assert rows[forms.index("x@b.c ")].n_email == 200_000 // 6
    short = [f * (600 // len(f)) for f in forms]
    frame = spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")
    check_base(sorted(personal_data.report(frame, model).collect(), key=lambda r: r.doc_id), short)


def test_running_results():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rng = random.Random(1)
    for n in (0, 1, 127, 128, 129, 1000):
        v = [rng.randrange(50) for _ in range(n)]
        df = spark.createDataFrame([(v,)], "v array<int>").selectExpr(f"{personal_data.running('v', personal_data.SUM)} AS s", f"{personal_data.running('v', personal_data.MOST)} AS m").first()
        assert list(df.s) == [sum(v[: i + 1]) for i in range(n)]
        assert list(df.m) == [max(v[: i + 1]) for i in range(n)]


def test_selection_on_examples_that_were_not_fitted_to(spark, model):
    """Other contexts and other draws of all forms: nearly all true forms are covered, and nearly no look-alike is touched."""
    contexts = [r.t for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id > 500 and not text rlike '[0-9@=]'").selectExpr("substring(text, 30, 150) AS t").limit(80).collect()]
    plants = personal_data.planted(contexts, random.Random(77), 30)
    frame = spark.createDataFrame([(i, p[1]) for i, p in enumerate(plants)], "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r.spans for r in personal_data.report(frame, model).collect()}
    hits, all_true, touched, look_alikes = {}, {}, 0, 0
    for i, (_, _, lo, hi, kind) in enumerate(plants):
        spans = [(int(a), int(z)) for _, a, z in (s.split(":") for s in rows[i].split(",") if s)]
        covered = sum(max(0, min(z, hi) - max(a, lo)) for a, z in spans)
        if kind:
            all_true[kind] = all_true.get(kind, 0) + 1
            hits[kind] = hits.get(kind, 0) + (covered >= hi - lo - 2)
        else:
            look_alikes += 1
            touched += covered > 0
    print({k: (hits[k], all_true[k]) for k in all_true}, touched, look_alikes)
    assert sum(hits.values()) >= 0.93 * sum(all_true.values())
    assert touched <= 0.04 * look_alikes


def test_nulls_repeats_clashing_columns_and_redaction(spark, model):
    texts = ["mail ann.b@c.de or call +1 (555) 123-4567 now", None, "", "plain words only", 'a token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" b']
    rows = [*((i, t, 1, "x", 2, 3) for i, t in enumerate(texts)), (0, texts[0], 1, "x", 2, 3), (None, texts[0], 1, "x", 2, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, t int, base string, spans int, _whole int").repartition(2)
    got = personal_data.report(frame, model).collect()
    assert len(got) == len(rows)
    assert {r.spans for r in got if r.doc_id in (0, None)} == {"email:5:15,phone:24:41"}
    assert {(r.doc_id, r.spans) for r in got if r.doc_id in (1, 2, 3)} == {(1, ""), (2, ""), (3, "")}
    assert {r.spans for r in got if r.doc_id == 4} == {"secret:11:51"}
    red = personal_data.redact(frame, model)
    assert red.columns == frame.columns
    assert {(r.doc_id, r.text, r.base) for r in red.collect()} == {(0, "mail [email] or call [phone] now", "x"), (None, "mail [email] or call [phone] now", "x"), (1, None, "x"), (2, "", "x"), (3, "plain words only", "x"), (4, 'a token = "[secret]" b', "x")}
    assert personal_data.report(frame.limit(0), model).count() == 0
    assert personal_data.fit(frame.limit(0)).thresholds.keys() == set(personal_data.KINDS)
