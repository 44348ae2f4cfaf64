"""The licence scan against brute force over all windows: notices wrapped over lines, embedded, of other versions."""

import random
import textwrap

from marketloom.llm import license_scan as L


def brute(text, threshold=0.9):
    """Licences of all windows that reach the threshold, with their Dice coefficients."""
    w = L.normalised_words(text)
    g = [f"{a} {b}" for a, b in zip(w, w[1:])]
    out = set()
    for name, template in L.TEMPLATES:
        t, v = set(L.bigram_set(L.normalised_words(template))), L.version_words(L.normalised_words(template))
        most = len(t) * (2 - threshold) / threshold
        for a in range(len(g)):
            for b in range(a, min(len(g), a + int(most))):
                part = set(g[a : b + 1])
                dice = 2 * len(part & t) / (len(part) + len(t))
                if dice >= threshold and (not v or L.version_words(w[a : b + 2]) == v):
                    out.add((name == "proprietary", -round(dice, 6), a, name))
    return min(out)[1:] if out else None


def line_of(text, a):
    n = 0
    for k, line in enumerate(text.split("\n")):
        n += len(L.normalised_words(line))
        if n > a:
            return k


def test_windows_against_brute_force(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice(["the", "of", "river", "license", "version", "under", "2", "rights"]) for _ in range(n))
    texts = [None, "", "word", "nothing here", "GPL\n\n" + textwrap.fill(dict(L.TEMPLATES)["GPL-3.0"].replace("version 3", "version 2"), 72)]
    for _, t in L.TEMPLATES:
        texts += [textwrap.fill(filler(9) + " " + t + " " + filler(9), 50), filler(20) + " " + t + " " + filler(20)]
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append("Copyright. All rights reserved.\n" + textwrap.fill(" ".join(words), 40))
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id int, text string").repartition(8)).collect()}
    assert got[4].license == "GPL-2.0" and got[4].line_no == 2
    assert sum(r.license is not None for r in got.values()) > 2 * len(L.TEMPLATES)
    for i, t in rows:
        want = brute(t or "")
        r = got[i]
        assert (r.license, r.dice, r.line_no) == ((want[2], -want[0], line_of(t, want[1])) if want else (None, None, None)), t
        assert (r.n_matches > 0) == (want is not None) and (want is None or r.line == t.split("\n")[r.line_no])


def test_whole_licences_against_brute_force(spark):
    """Wrapped, embedded and edited bodies; windows of all sizes, grown word by word."""
    rng = random.Random(5)
    every = [(n, set(L.bigram_set(L.normalised_words(t))), L.version_words(L.normalised_words(t))) for n, t in L.TEMPLATES + L.BODIES]
    texts = []
    for _, t in L.BODIES:
        w = t.split()
        cut = w[: len(w) // 2] + w[len(w) // 2 + 3 :]
        texts += [textwrap.fill(t, 60), "x y z\n" + textwrap.fill(" ".join(cut), 72, initial_indent="# ", subsequent_indent="# ") + "\nend of it"]
        edited = [x if rng.random() < 0.9 else "other" for x in w]
        texts.append(" ".join(edited))
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(8)).collect()}
    for i, text in enumerate(texts):
        w = L.normalised_words(text)
        g = [f"{a} {b}" for a, b in zip(w, w[1:])]
        out = set()
        for name, t, v in every:
            for a in range(len(g)):
                part, common = set(), 0
                for b in range(a, min(len(g), a + int(len(t) * 1.1 / 0.9))):
                    if g[b] not in part:
                        part.add(g[b])
                        common += g[b] in t
                    if 2 * common >= 0.9 * (len(part) + len(t)) and (not v or L.version_words(w[a : b + 2]) == v):
                        out.add((name == "proprietary", -round(2 * common / (len(part) + len(t)), 6), a, name))
        want = min(out)[1:] if out else None
        assert (got[i].license, got[i].dice) == ((want[2], -want[0]) if want else (None, None))
    assert [got[3 * k].license for k in range(len(L.BODIES))] == [n for n, _ in L.BODIES]
