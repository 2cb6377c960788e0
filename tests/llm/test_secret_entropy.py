"""Entropy spans of the secret scan against a plain version, random keys and words."""

import random
import re
import string
from math import log2

from pyspark.sql import functions as F

from quarry.llm import secrets
from tests.llm import brute

W = secrets.WINDOW
CLASS = {name: (re.compile(p), least) for name, p, least in secrets.CLASSES}
ALLOWED = re.compile("|".join(p.replace("(?i)", "") for p in secrets.ALLOWED), re.I)


def entropy(t):
    return -sum(t.count(c) / W * log2(t.count(c) / W) for c in set(t))


def plain_spans(t):
    base = sorted((int(s), int(e)) for s, e in (x.split(":")[1:] for x in brute.base_spans(t)))
    out = []
    for m in re.finditer(secrets.CANDIDATE, t):
        cuts = sorted([b for b in base if b[0] < m.end() and m.start() < b[1]] +
                      [(m.start() + a.start(), m.start() + a.end()) for a in ALLOWED.finditer(m.group())])
        at, pieces = m.start(), []
        for s, e in [*cuts, (m.end(), m.end())]:
            if s - at >= W:
                pieces.append((at, s))
            at = max(at, e)
        for s, e in pieces:
            p = t[s:e]
            name = next((n for n, (r, _) in CLASS.items() if r.search(p)), None)
            if name:
                hot = [i for i in range(len(p) - W + 1) if entropy(p[i:i + W]) >= CLASS[name][1] - 1e-12]
                if hot:
                    out.append(f"{name}:{s + hot[0]}:{s + hot[-1] + W}")
    return out


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("t", "base", "cand", "assign", "spans", "s", "e")})
    rows = secrets.summary(secrets.scan(df)).collect()
    return {r.doc_id: [s for s in r.spans.split(",") if s.startswith("entropy")] for r in rows}


def test_spans_against_a_plain_version(spark):
    rnd = random.Random(4)
    key = lambda n, a: "".join(rnd.choices(a, k=n))
    mixed = string.ascii_letters + string.digits
    texts = ["my-sample-key=Zx81kQ7mP2vL9sT4wR6y", "/usr/local/share/applications/python3/site-packages/requests", None, "",
             f"https://x.org/{key(24, mixed)}/token=abc123def", f"token={key(30, mixed)}", f"{key(25, mixed)}example{key(25, mixed)}",
             f"é {key(22, mixed)}token:{key(22, mixed)} é", "0" * 40, "a" * 40, key(40, string.digits), key(30, string.ascii_letters),
             key(24, "0123456789ABCDEF"), "AKIA" + key(20, string.ascii_uppercase + string.digits), f"{key(21, mixed)}=="]
    got = scanned(spark, texts)
    assert got == {i: plain_spans(t or "") for i, t in enumerate(texts)}
    assert got[0] == ["entropy_mixed:14:34"] and got[1] == [] and len(got[4]) == 1 and got[11]
    assert got[5] == [] and len(got[6]) == 2 and got[8] == got[9] == got[10] == []


def test_random_keys_are_found_and_words_are_not(spark):
    rnd = random.Random(9)
    kinds = {"mixed": string.ascii_letters + string.digits, "letters": string.ascii_letters, "hex": "0123456789ABCDEF",
             "base64": string.ascii_letters + string.digits + "+"}
    keys = [f"key {''.join(rnd.choices(a, k=32))} end" for a in kinds.values() for _ in range(100)]
    found = scanned(spark, keys)
    for k, name in enumerate(kinds):
        assert sum(bool(found[i]) for i in range(k * 100, k * 100 + 100)) >= 90, name
    words = ["internationalization", "electroencephalographically", "counterrevolutionaries", "get_default_session_factory",
             "the_quick_brown_fox_jumps", "Donaudampfschifffahrtsgesellschaft", "SomeVeryLongJavaClassNameFactoryBean",
             "/home/user/projects/application_server/configuration", "1234567890123456789012345", "2024_01_02_03_04_05_06_07",
             "node_modules/typescript/lib/typescriptServices", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "AAAAAAAAAAAAAAAAAAAAAAAA0000"]
    assert {i: s for i, s in scanned(spark, words).items() if s} == {}
