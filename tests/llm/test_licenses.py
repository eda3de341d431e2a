from helpers import ODD, frame
from zonecast.llm import licenses as c


def brute(rows):
    import re

    gaps = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    toks = lambda t: [w for w in gaps.split(t.translate({i: i + 32 for i in range(65, 91)})) if w]
    grams = lambda w: set(zip(w, w[1:]))
    out = []
    for i, text in rows:
        text = text or ""
        best, n = [], 0
        for seg in {*text.split("\n"), *re.split(r"\n[\x20\x09-\x0D]*\n", text), text}:
            a = grams(toks(seg))
            for name, t in c.TEMPLATES:
                b = grams(toks(t))
                score = 2.0 * len(a & b) / (len(a) + len(b)) if a else 0
                if score >= c.THRESHOLD:
                    best.append((-score, name))
                    n += 1
        best.sort()
        out.append(((i is None, i or 0), best[0][1] if best else "", -best[0][0] if best else 0.0, n))
    return sorted(out)


def test_against_plain_python(spark):
    mit = c.TEMPLATES[12][1]
    rows = [*ODD, (20, "x\nReleased under the MIT License.\ny"), (21, mit.upper()), (22, "a b\n\n" + mit.replace(", ", ",\n") + "\n\nend of it"),
            (23, "licensed under cc by nc 4.0"), (24, "word " * 30_000), (25, "License"), (26, "\n\n\n"), (27, "Released under MIT License.")]
    got = c.scan(frame(spark, rows, clash=True)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.license or "", r.score, r.n_matches) for r in got) == brute(rows)


def test_empty_and_bounds(spark):
    df = frame(spark, ODD)
    assert c.scan(df.limit(0)).count() == 0
    assert {r.license for r in c.scan(df, templates=[]).collect()} == {None}
    import pytest

    with pytest.raises(ValueError):
        c.scan(df, templates=[("x", " ".join(map(str, range(30_000))))])


def test_no_match_is_without_a_telling_bigram():
    import random

    rng = random.Random(8)
    known = [(n, c.template_bigrams(t)) for n, t in c.TEMPLATES]
    for threshold in (0.5, 0.8, 0.95):
        told = set(c.telling_bigrams(known, threshold))
        for _, bigrams in known:
            for _ in range(200):
                # any part of a template, with words of its own around, that reaches the threshold
                kept = rng.sample(bigrams, rng.randint(0, len(bigrams)))
                size = len(kept) + rng.randint(0, 5)
                if 2 * len(kept) >= threshold * (size + len(bigrams)):
                    assert told & set(kept)
    assert c.telling_bigrams(known, 0.0) is None


def test_telling_pattern_finds_what_the_plain_alternatives_find():
    import random
    import re

    bigrams = c.telling_bigrams([(n, c.template_bigrams(t)) for n, t in c.TEMPLATES], c.THRESHOLD)
    pattern = c.telling_pattern(bigrams)
    rng = random.Random(3)
    gaps = [" ", "\n", " - ", ".", "_", "é", ""]
    for _ in range(400):
        a, b = rng.choice(bigrams).split(" ")
        text = rng.choice(["", "x ", "é ", "\n"]) + a.upper() + rng.choice(gaps) + b + rng.choice(["", " y", "."])
        words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()
        has = any(f"{x} {y}" in bigrams for x, y in zip(words, words[1:]))
        assert re.search(pattern, text) or not has
    # a word that starts inside another one, or no second word
    assert not re.search(pattern, "xabove copyright") and not re.search(pattern, "above")
