from collections import Counter

from corpus import awkward, frame, words
from seqloom.llm import quality


def plain(text):
    text = text or ""
    w = words(text)
    lines = [s for s in text.split("\n") if words(s)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
        len(w) < 20 or 100 * len(hit) > 30 * len(w),
    )


def test_measures_equal_plain_python(spark):
    rows = awkward()
    got = quality.judge(frame(spark, rows)).select("text", "quality.*").collect()
    assert len(got) == len(rows)
    for r in got:
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert own == plain(r.text)
        assert not (r.base_failed and r.kept)


def test_rules_decide(spark):
    good = "the house of the river and the red stone is in the old town that was built for this and it is on a hill by the sea"
    texts = [good, good.upper() + "!!", " ".join(w + "%%$" for w in good.split()), "\n".join([good] + ["of the same line"] * 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id: r.quality.kept for r in quality.judge(docs).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False}


def test_empty_table(spark):
    assert quality.judge(frame(spark, [])).count() == 0
