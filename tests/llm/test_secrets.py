import random
import re

from pyspark.sql import functions as F

from lexalloy.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(out)


def random_string(r, alphabet, n):
    return "".join(r.choice(alphabet) for _ in range(n))


B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def odd_texts():
    r = random.Random(4)
    bits = ["password", "Token", "API_KEY", "apikey", "secret", "=", ":", ' "', "'", " ", "\n", "AKIA", "AKIAAKIA", "😀", "é", "x", "==", "token:token:abcdefghijklmnop", "."]
    out = [None, "", "token=", "AKIA" * 9, "f" * 16, "0" * 15 + "g", "token: token:abcdefghijklmnop"]
    for _ in range(150):
        parts = [r.choice(bits) if r.random() < 0.6 else random_string(r, r.choice(["abcdef0123456789", "ABCDEFGHIJK0123", "ab.=/+-_Z"]), r.choice([3, 11, 12, 16, 17, 30])) for _ in range(r.randint(0, 12))]
        out.append("".join(parts))
    out.append(" ".join(random_string(r, "0123456789abcdef", 20) for _ in range(700)))
    return out


def test_base_equals_brute_force(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int").drop("spans")
    for r in secrets.scanned(docs).collect():
        assert [tuple(s) for s in r.base] == brute(texts[r.doc_id]), texts[r.doc_id]
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def prose(r, n):
    return " ".join("".join(r.choice(["th", "er", "an", "keit", "schaft", "ion", "lich", "re", "ou", "in"]) for _ in range(r.choice([1, 2, 3, 8]))) for _ in range(n))


def test_battery_finds_random_strings_and_leaves_prose(spark):
    r = random.Random(8)
    keys = {i: random_string(r, B62, 40) for i in range(0, 60, 3)}
    texts = [(i, prose(r, 60) + " " + (keys[i] + " " if i in keys else "thereversion2andsoonandon chapter-12-and-13-of-the-book ") + prose(r, 60)) for i in range(60)]
    out = {x.doc_id: [tuple(s) for s in x.spans] for x in secrets.scanned(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    hit = [i for i, t in texts if any(t[a:b] == keys.get(i) for a, k, b in out[i])]
    assert len(hit) >= 0.9 * len(keys)
    assert not any(out[i] for i, _ in texts if i not in keys)


def test_battery_finds_keys_without_digits(spark):
    r = random.Random(9)
    keys = {i: random_string(r, B62[:52], r.choice([32, 40])) for i in range(0, 60, 3)}
    texts = [(i, prose(r, 60) + " " + (keys[i] + " " if i in keys else "getElementsByClassNameFromDocument src/main/java/com-example/SomeClass the-third-chapter-of-this-book ") + prose(r, 60)) for i in range(60)]
    out = {x.doc_id: [tuple(s) for s in x.spans] for x in secrets.scanned(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    hit = [i for i, t in texts if any(t[a:b] == keys.get(i) for a, k, b in out[i])]
    assert len(hit) >= 0.9 * len(keys)
    assert not any(out[i] for i, _ in texts if i not in keys)


def test_empty_table_and_repeats(spark):
    assert secrets.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = secrets.scanned(spark.createDataFrame([(1, "f" * 20), (1, "f" * 20), (None, "e" * 20)], "doc_id long, text string")).collect()
    assert len(rows) == 3 and all(len(x.spans) == 1 for x in rows)


def test_redaction(spark):
    text = "é " + "f" * 20 + " token=" + "a" * 20 + " end"
    docs = spark.createDataFrame([(1, text), (2, "clean"), (3, "")], "doc_id long, text string").withColumn("found", secrets.base_spans(F.col("text")))
    assert [x.t for x in docs.select(secrets.redacted(F.col("text"), F.col("found")).alias("t")).collect()] == ["é [redacted] [redacted] end", "clean", ""]


def test_redaction_of_many_and_overlapping_spans(spark):
    text = "ab" * 1000
    found = [(i * 5, 0, i * 5 + 2) for i in range(300)] + [(7, 1, 26)]
    docs = spark.createDataFrame([(text, sorted(found)), (text, []), (None, [(0, 0, 1)])], "text string, s array<struct<start:int,kind:int,end:int>>")
    rows = docs.select(secrets.redacted(docs.text, docs.s, "#").alias("t")).collect()
    want, at = "", 0
    for start, _, end in sorted(found):
        if start >= at:
            want += text[at:start] + "#"
        at = max(at, end)
    assert [r.t for r in rows] == [want + text[at:], text, None]
