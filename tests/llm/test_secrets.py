import random
import re
import string

from corpus import awkward, frame
from seqloom.llm import secret_scan

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def plain(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(found)


def key(seed, symbols, n):
    r = random.Random(seed)
    return "".join(r.choice(symbols) for _ in range(n))


def rows():
    pieces = ["password=", "PassWD : ", "secret=token", "token = \"", "api_key:'", "APIKEY==", "AKIA", "AKIAAKIA", "é😀", " ", "\n", "'", '"', ":", "=",
              "abcdefgh", "0123456789abcdef", "ABCDEFGHIJKLMNOP", "short", "K", "."]
    r = random.Random(11)
    made = [(100 + i, "".join(r.choice(pieces) for _ in range(r.randrange(30)))) for i in range(300)]
    return awkward() + made + [(500, "pad " * 5000 + "secret: 12345678"), (501, "password=b7db7aa4a5fcc78305"), (502, "secret=token = \"abcdefgh\"")]


def test_base_spans_equal_plain_python(spark):
    data = rows()
    got = secret_scan.scan(frame(spark, data)).select("text", "secrets").collect()
    assert len(got) == len(data)
    for r in got:
        assert [(s.start, s.rank, s.end) for s in r.secrets if s.rank < 3] == plain(r.text)
        spans = [(s.start, s.rank) for s in r.secrets]
        assert spans == sorted(spans)
        assert all(s.kind == secret_scan.KINDS[s.rank] for s in r.secrets)


def test_random_keys_are_found_and_words_left(spark):
    alphabets = [string.digits + "abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/"]
    keys = [(i, f"the key is {key(i, alphabets[i % 4], 31 if i % 4 == 0 else 40)} here") for i in range(80)]
    plain_texts = ["internationalization-and-localization1 guide", "11111111111111111111aaaaaaaaaaaaaaaa", "abababababababababababab1212", "aaaabbbbccccddddeeeeffff0000",
                   "https/example/path/to/the/article/about/something/2024/page", "the_quick_brown_fox_jumps_over_the_lazy_dog_1", "12345678901234567890123456789"]
    texts = [(1000 + i, t) for i, t in enumerate(plain_texts)]
    got = {r.doc_id: [s for s in r.secrets if s.rank == 3] for r in secret_scan.scan(frame(spark, keys + texts)).collect()}
    assert sum(len(got[i]) == 1 and (got[i][0].start, got[i][0].end) == (11, len(t) - 5) for i, t in keys) >= 70
    assert [i for i, _ in texts if got[i]] == []


def test_redaction(spark):
    docs = frame(spark, rows())
    spans = secret_scan.scan(docs)
    got = spans.select("text", "secrets", secret_scan.redact(spans.text, spans.secrets).alias("out")).collect()
    for r in got:
        if r.text is None:
            assert r.out is None
            continue
        want, at = "", 0
        for s in r.secrets:
            if s.start >= at:
                want += r.text[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        assert r.out == want + r.text[at:]


def test_normal_distribution(spark):
    from math import erf

    from pyspark.sql import functions as F

    for z in (-6.0, -1.5, -0.1, 0.0, 0.7, 2.3, 8.0):
        got = spark.range(1).select(secret_scan.normal_cdf(F.lit(z)).alias("p")).first().p
        assert abs(got - (1 + erf(z / 2**0.5)) / 2) < 1e-6


def test_empty(spark):
    assert secret_scan.scan(frame(spark, [])).count() == 0
