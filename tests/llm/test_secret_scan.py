import hashlib
import math
import random
import re
import time
from collections import Counter

from llm_cases import as_rows, both, empty

from cardflow.llm import secret_scan as s

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24])


def entropy(window):
    return -sum(c / len(window) * math.log2(c / len(window)) for c in Counter(window).values())


def hot(text):
    for word, length in s.ALLOWED:
        text = re.sub(word, " " * length, text, flags=re.IGNORECASE | re.ASCII)
    for m in re.finditer(s.CANDIDATE, text):
        value, starts = m.group(), []
        for i in range(len(value) - s.WIDTH + 1):
            window = value[i : i + s.WIDTH]
            least = s.HEX_BITS if re.fullmatch("[0-9a-fA-F]+", window) else s.MIXED_BITS
            if not re.fullmatch("[A-Za-z/_-]+|[0-9/_-]+", window) and entropy(window) >= least:
                starts.append(i)
        if starts:
            yield m.start() + starts[0], 3, m.start() + starts[-1] + s.WIDTH


def named(spans):
    return ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_equals_plain_search(spark):
    docs, pairs = both(spark)
    scanned = s.scan(docs)
    expected = []
    for i, t in pairs:
        own = base(t or "")
        counts = tuple(sum(x[1] == k for x in own) for k in range(3))
        expected.append((i, *counts, hashlib.sha256(named(own).encode()).hexdigest(), named(own + list(hot(t or "")))))
    found = as_rows(scanned, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert found == sorted(expected, key=repr)
    assert any("entropy:" in r[-1] for r in found) and any(r[2] for r in found)


def test_allow_list_silences_only_added_spans(spark):
    token = "kq7Zp2Vx9LmT4sWb8RnC3yHd1FgJ0uQe"
    docs = spark.createDataFrame([(1, token), (2, "example" + token), (3, f"token=example{token}")], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in s.scan(docs).collect()}
    assert found == {1: "entropy:0:32", 2: "entropy:7:39", 3: "assign:0:45,entropy:13:45"}


def test_class_and_placeholders_are_judged_by_window(spark):
    token = "kq7Zp2Vx9LmT4sWb8RnC3yHd1FgJ0uQe"
    texts = ["SIGNATURE=9F86D081884C7D659A2FEAA0C55AD015", f"path/api/test-env/{token}", "0123456789" * 4, "your_key_" + "ab" * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in s.scan(docs).collect()}
    assert found == {i: named(base(t) + list(hot(t))) for i, t in enumerate(texts)}
    assert found[0].endswith(f":{len(texts[0])}") and found[1].endswith(f":{len(texts[1])}") and found[2] == "hex:0:40"


def test_very_long_candidates_and_very_many_spans(spark):
    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    blob = "".join(rng.choice(alphabet) for _ in range(100_000))
    hexes = " ".join("%032x" % rng.getrandbits(128) for _ in range(20_000))
    texts = [blob, f"x {blob[:5000]}{'z' * 3000}{blob[5000:9000]}", hexes, "".join(rng.choice("abcdef0123456789ghz/") for _ in range(20_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.time()
    found = {r["doc_id"]: r["spans"] for r in s.scan(docs).collect()}
    assert time.time() - began < 60
    for i, t in enumerate(texts):
        assert found[i] == named(base(t) + list(hot(t))), i


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "token: abcdefgh", "a", "h", 5)], "doc_id long, text string, assign string, hex string, candidates int")
    assert [r["spans"] for r in s.scan(docs).collect()] == ["assign:0:15"]


def test_no_python_in_the_plan(spark):
    plan = s.scan(both(spark)[0])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_empty_table(spark):
    assert s.scan(empty(spark)).count() == 0
