import random
import re
from collections import Counter

from factloom.llm import quality


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 5))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_counts(docs):
    rng = random.Random(4)
    parts = ["a", "b ", "b ", "é", "#", "|", "\n", "\n", " ", "\t", "\r", "ab cd ef gh ij ", "line\n", "line \n", "A1 ", "😀 ", "\x0b"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "a b c d e f " * 3000), (904, "x" * 100_000), (None, "a b c")]
    got = {r.doc_id: r for r in quality.quality(docs(rows)).collect()}
    for i, text in rows:
        want = counts(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.quality(docs(rows).limit(0)).collect() == []


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 9)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(rng.choice((12, 60, 300)))]
        bad = i % 7 == 0
        rows.append((i, " ".join(w + "###" if bad else w for w in words), ("en", "fr", None)[i % 3], ("s1", None)[i % 2]))
    return rows + [(1000, "word " + " ".join(word() for _ in range(50)), "rare", "s9"), (1001, rows[1][1], "en", "s1"), (1001, rows[1][1], "en", "s1")]


def test_outliers_are_rejected_and_the_rest_kept(docs):
    rows = corpus()
    got = {r.doc_id: r for r in quality.quality(docs(rows)).collect()}
    assert {i for i, r in got.items() if not r.kept} == {i for i in range(600) if i % 7 == 0}


def test_distance_against_brute_force(docs):
    """The last estimate is that of the core it selects: concentration has come to rest, group by group."""
    import numpy as np

    rows = [r for r in corpus(2) if r[0] < 600]
    got = {r.doc_id: r.distance for r in quality.quality(docs(rows)).collect()}
    for lang in ("en", "fr", None):
        for source in ("s1", None):
            own = [r for r in rows if r[2] == lang and r[3] == source]
            x = quality.statistics(quality.text_counts([r[1].encode() for r in own]))
            keep = np.argsort(((x - np.median(x, axis=0)) ** 2 / ((1.4826 * np.median(abs(x - np.median(x, axis=0)), axis=0)) ** 2 + np.square(quality.FLOORS))).sum(axis=1))[:int(np.ceil(0.75 * len(x)))]
            for _ in range(quality.STEPS):
                z = x - x[keep].mean(axis=0)
                d = np.einsum("ij,jk,ik->i", z, np.linalg.inv(np.cov(x[keep].T, bias=True) + np.diag(np.square(quality.FLOORS))), z)
                keep = np.argsort(d)[:int(np.ceil(0.75 * len(x)))]
            scale = max(1.0, np.sort(d)[(len(d) - 1) // 2] / quality._MEDIAN)
            close = [abs(got[r[0]] - v / scale) <= 0.1 * (v / scale) + 0.05 for r, v in zip(own, d)]
            assert np.mean(close) > 0.95


def test_an_outlier_in_each_single_statistic(docs):
    """One trait alone is enough, also where the base rules hold and the group is large."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: [word() for _ in range(n)]
    rows = []
    for i in range(400):
        words = prose(rng.choice((60, 120, 300)))
        words[5], words[20] = words[5].capitalize(), str(rng.randrange(10))
        rows.append((i, "\n".join(" ".join(words[k:k + 12]) for k in range(0, len(words), 12))))
    passage = prose(25)
    odd = {
        "long words": " ".join("".join(prose(5)) for _ in range(200)),
        "symbols": " ".join(w + "##" for w in prose(200)),
        "duplicate lines": "\n".join(line for k in range(60) for line in ("ab cd", word())),
        "repeated words": " ".join(prose(100) + passage + prose(50) + passage + prose(80)),
        "upper case": " ".join(prose(200)).upper(),
        "digits": " ".join(str(rng.randrange(1000, 100_000)) for _ in range(200))}
    rows += list(enumerate(odd.values(), 1000))
    got = {r.doc_id: r for r in quality.quality(docs(rows)).collect()}
    assert [name for i, name in enumerate(odd, 1000) if got[i].kept or got[i].base_failed] == []
    assert sum(got[i].kept for i in range(400)) >= 396
