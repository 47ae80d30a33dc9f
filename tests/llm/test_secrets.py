import hashlib
import math
import random
import re
from collections import Counter

from tidemart.llm import queries, secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII)
BASE = [("assign", ASSIGN, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def base_spans(text):
    found = [(m.start(), n, m.end(), k) for n, (k, p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m)]
    return sorted(found)


def entropy_spans(text):
    out = []
    allow = re.compile("|".join(f"(?:{x})" for x in secrets.ALLOW_LIST))
    for n, (kind, (pattern, w, least)) in enumerate(secrets.CLASSES.items()):
        marked = set()
        for m in re.finditer(pattern, text):
            if allow.search(m[0]):
                continue
            for i in range(len(m[0]) - w + 1):
                part = m[0][i:i + w]
                h = math.log2(w) - sum(c * math.log2(c) for c in Counter(part).values()) / w
                if round(h, 9) >= least and re.search("[0-9]", part) and re.search("[A-Za-z]", part):
                    marked |= {m.start() + i + j for j in range(w)}
        begin = sorted(x for x in marked if x - 1 not in marked)
        end = sorted(x + 1 for x in marked if x + 1 not in marked)
        out += [(a, 3 + n, b, kind) for a, b in zip(begin, end, strict=True)]
    return out


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    pieces = ["token: ", "token: abc ", "API_KEY='", "secret = ", "passwd:", "AKIA", "é", "😀 ", "\n", " word ", "example",
              "sha256-", "0f3a9c", "=" * 3, "123e4567-e89b-12d3-a456-426614174000"]
    alphabet = {0: "0123456789abcdef", 1: "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
                2: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}

    def text():
        out = ""
        for _ in range(rnd.randint(0, 9)):
            out += rnd.choice(pieces)
            if rnd.random() < 0.7:
                out += "".join(rnd.choices(alphabet[rnd.randrange(3)], k=rnd.randint(1, 70)))
        return out

    texts = [text() for _ in range(150)] + [None, "", "token: token: abcdef1"]
    # a long candidate, cut into blocks: quiet, noisy, quiet
    noise = "".join(rnd.choices(alphabet[2], k=1500))
    texts.append("a1" * 700 + noise + "b2" * 700)
    rows = list(enumerate(texts)) + [(0, texts[0])]
    frame = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, base string")
    got = sorted(map(tuple, secrets.secrets_digest(secrets.scan_secrets(frame)).collect()))
    want = []
    for i, t in rows:
        base = base_spans(t or "")
        kinds = Counter(k for _, _, _, k in base)
        want.append((i, kinds["assign"], kinds["access"], kinds["hex"],
                     hashlib.sha256(written(base).encode()).hexdigest(),
                     written(sorted(base + entropy_spans(t or "")))))
    assert got == sorted(want)
    assert any("entropy_base64" in w[5] for w in want) and any("entropy_hex" in w[5] for w in want)


def test_no_rows_and_native(spark, nothing):
    assert secrets.scan_secrets(nothing).count() == 0
    plan = queries.op3_secret_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_a_long_text_of_many_matches(spark, tmp_path):
    """Each of 12,000 runs is a base span, an entropy span, or both, and assignments come between."""
    rnd = random.Random(8)
    text = " ".join("".join(rnd.choices("0123456789abcdef", k=24)) + ("" if i % 3 else f" token={i:08d}")
                    for i in range(12_000))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "long"))
    found = secrets.secrets_digest(secrets.scan_secrets(spark.read.parquet(str(tmp_path / "long"))))
    row = found.collect()[0]
    base = base_spans(text)
    assert (row["n_hex"], row["n_assign"]) == (12_000, 4_000)
    assert row["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
    assert row["spans"] == written(sorted(base + entropy_spans(text)))
