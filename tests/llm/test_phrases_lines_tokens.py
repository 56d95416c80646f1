"""Collocations, shared lines and token alignment against brute force and on odd input."""

import hashlib
import os
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

from kgloom.llm import alignment, collocations, line_dedup

rng = random.Random(13)
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, id string, block long, pos int, phrase string, keep string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "c", 1, 2, "c", "c", 3) for i, t, lang in rows], SCHEMA)


# Collocations


def phrase_counts(rows, longest):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def best_phrases(rows, k, least, longest=3):
    f, n = phrase_counts(rows, longest)
    out = []
    for lang, counts in f.items():
        phrases = {p: a for p, a in counts.items() if len(p) >= 2 and a >= least}
        found = []
        for p, a in phrases.items():
            inside = [x for x in phrases if len(x) > len(p) and any(x[i : i + len(p)] == p for i in range(len(x) - len(p) + 1))]
            if any(100 * phrases[x] >= 50 * a for x in inside):
                continue
            score, _, left, right = min((1000000 * a * a // (counts[p[:c]] * counts[p[c:]]), c, counts[p[:c]], counts[p[c:]]) for c in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:k], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def sentence(words, n):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", " é ", "! "]) for _ in range(n))


FEW = ["New", "york", "the", "Of", "straße", "ÉTÉ", "x\x00y", "a-b", "in", "place"]
PROSE = [(i, sentence(FEW, rng.randrange(1, 60)), rng.choice(["en", "de", None])) for i in range(60)]
PROSE += [(100, None, "en"), (101, "", None), (102, " \n ", "fr"), (103, sentence(FEW, 5000), "en"), (None, "new york " * 30, "en"), (3, "same row here", "de"), (3, "same row here", "de"), (105, "hot " * 4000, "de")]


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 200, "part_mass": 300}])
def test_collocations_against_brute_force(spark, sizes):
    docs = frame(spark, PROSE).repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, k=12, least=4, **sizes).collect())
    assert got == best_phrases(PROSE, 12, 4) and len(got) > 20
    assert collocations.collocations(docs.limit(0)).count() == 0
    longer = sorted(tuple(r) for r in collocations.collocations(docs, k=8, least=6, longest=4, **sizes).collect())
    assert longer == best_phrases(PROSE, 8, 6, 4)


def test_counts_of_every_frequent_phrase(spark):
    got = {(r["lang"], r["phrase"]): r["n"] for r in collocations.frequent_grams(frame(spark, PROSE).repartition(4), least=3, block_bytes=300, part_mass=200).collect()}
    f, n = phrase_counts(PROSE, 3)
    want = {(lang, " ".join(p)): a for lang, c in f.items() for p, a in c.items() if a >= 3} | {(lang, ""): n[lang] for lang in f}
    assert {k: v for k, v in got.items() if v or k[1]} == {k: v for k, v in want.items() if v or k[1]}


def test_summaries_lose_nothing_frequent_and_stay_small():
    for _ in range(40):
        least, blocks = rng.choice([2, 5, 10]), []
        for _ in range(rng.randrange(1, 30)):
            keys = np.unique(np.array([int(rng.paretovariate(0.6)) % 5000 for _ in range(rng.randrange(1, 400))], np.uint32))
            blocks.append((keys, np.array([rng.randrange(1, least + 1) for _ in keys])))
        mass, total = sum(int(c.sum()) for _, c in blocks), Counter()
        summary = collocations.Summary(mass // least + 1)
        for keys, counts in blocks:
            total.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
            summary.add(keys, counts)
            summary.merge()
            assert len(summary.keys) <= summary.capacity
        frequent = {k for k, v in total.items() if v >= least}
        assert frequent <= set(summary.keys.tolist())
        told = collocations.survivors([(collocations.pack(k, c), len(k)) for k, c in blocks], mass, least)
        assert all(set(k[s].tolist()) == frequent & set(k.tolist()) for (k, _), s in zip(blocks, told, strict=True))


def test_products_beyond_64_bits(spark):
    grams = spark.createDataFrame([("en", 1, "a", 4 * 10**15), ("en", 1, "b", 3 * 10**15), ("en", 2, "a b", 2999999999999999)], "lang string, words int, phrase string, n long")
    row = collocations.scored(grams).head()
    assert row["score"] == 1000000 * 2999999999999999**2 // (4 * 10**15 * 3 * 10**15)


# Shared lines

LINES = ["  The same long line of a footer\t", "the SAME long line of a footer", "short", "", "ÉTÉ is a line with an accent in it", "été is a line with an accent in it", "x" * 19, "y" * 20, "\x0b\x0cz" + "z" * 25]
TEXTS = ["\n".join(rng.choice([*LINES, f"own line number {rng.randrange(10**6)} of many"]) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
HELD = [(i, t, "en") for i, t in enumerate(TEXTS)]
HELD += [(200, None, None), (201, "", None), (202, "\n\n", "en"), (7, TEXTS[7], "en"), (7, LINES[0] + "\nother", "en"), (None, LINES[0] + "\n" + "only without an id here", "x"), (None, "only without an id here\nq", "x"), (300, "\n".join([LINES[0], LINES[7]] * 30000), "en"), (301, LINES[0] + "\r\n" + LINES[0], "en")]


def without_shared(rows, least_chars=20, least_docs=3):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < least_docs or i == max(holders[key(x)], key=lambda d: -1 if d is None else d)]
        out.append((str(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_shared_lines_against_brute_force(spark):
    docs = frame(spark, HELD).repartition(4)
    got = sorted((str(r["id"]), r["kept"], r["n_lines"], r["n_dropped"]) for r in line_dedup.deduplicated(docs).collect())
    assert got == without_shared(HELD) and sum(x[3] for x in got) > 50
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0
    plan = line_dedup.deduplicated(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Token alignment

SAID = ["Hello wörld", "", None, " leading and  double ", "▁ mark in a text", "<s> </s> <|endoftext|> are text", "tab\tand\nnewline\r\n", "\U0001f600‍ naïve ÉTÉ 日本語", "a" * 4000, "\x00 nul", "word " * 3000, "Hello wörld"]
SPOKEN = [(i, t, "en") for i, t in enumerate(SAID)] + [(4, "Hello again", "en"), (None, "no id", None)]


@pytest.mark.skipif(not os.path.exists(alignment.BYTE_PATH), reason="no tokenizers")
def test_alignment_against_brute_force(spark, monkeypatch):
    sides = alignment.load_sides()
    coders = alignment.Encoders(sides)
    want, counts, overlapping = [], Counter(), []
    for i, text, _ in SPOKEN:
        whole = (" " + (text or "")).encode()
        a = coders.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = coders.b.encode(text or "")
        if not text or b"".join(coders.a_bytes[x] for x in a) != whole or b"".join(coders.b_bytes[x] for x in b) != whole:
            want.append((str(i), 0, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(side[x]) for x in ids]).tolist() for side, ids in ((coders.a_bytes, a), (coders.b_bytes, b))]
        groups, x, y = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            u, v = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(map(str, a[x:u])) + "|" + ",".join(map(str, b[y:v])))
            x, y = u, v
        links = [(a[j], b[ends[1].index(e)]) for j, e in enumerate(ends[0]) if e in ends[1]]
        counts.update(links)
        want.append((str(i), len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        if len(a) < 100:
            span = [list(zip([0, *e[:-1]], e, strict=True)) for e in ends]
            overlapping += [(str(i), j, k, a[j], b[k], max(p[0], q[0]), min(p[1], q[1])) for j, p in enumerate(span[0]) for k, q in enumerate(span[1]) if p[0] < q[1] and q[0] < p[1]]
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    want = sorted((*w[:4], len(w[4]), sum(counts[x] == most[x[1]] for x in w[4]), sum(counts[x] for x in w[4]), w[5]) for w in want)
    docs = frame(spark, SPOKEN).repartition(3)
    got = sorted((str(r["id"]), *[r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")]) for r in alignment.alignment(docs, sides).collect())
    assert got == want and sum(w[1] == 0 for w in want) >= 2
    monkeypatch.setattr(alignment, "BROADCAST_BYTES", 0)
    joined = sorted((str(r["id"]), *[r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")]) for r in alignment.alignment(docs, sides).collect())
    assert joined == want
    pairs = sorted((str(r[0]), *r[1:]) for r in alignment.overlaps(docs.where("length(text) < 100"), sides).collect())
    assert pairs == sorted(overlapping)
    assert alignment.alignment(docs.limit(0), sides).count() == 0
    assert len(counts) <= alignment.most_pairs(coders.a_bytes, coders.b_bytes)


@pytest.mark.skipif(not os.path.exists(alignment.BYTE_PATH), reason="no tokenizers")
def test_stretches_and_the_fast_coder_change_no_id():
    coders = alignment.encoders(alignment.load_sides())
    signs = [chr(c) for c in range(0x250)]
    texts = ["".join(f"{a}{c}{b}" for a in ("a", " ", "1", ".", "\n", "'") for b in ("b", " ", "2", "!", "\t")) for c in signs]
    texts += ["".join(rng.choice("abcdefghijklmnop éèßñ   '.,0123456789\n\t▁日") for _ in range(90)) for _ in range(2000)]
    plain = [x.decode() for x in coders.a_bytes if x.isascii()]
    texts += plain + [a + b for a, b in zip(rng.sample(plain, 9000), rng.sample(plain, 9000), strict=True)]
    slow = coders.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
    assert all(a.ids == b for a, b in zip(slow, coders.encode_bytes(texts), strict=True))
    # Texts by their stretches, remembered or not, against texts as one.
    for _ in range(2):
        docs, ids = coders.encode([t.encode() for t in texts])
        whole = coders.encode_each(texts)
        for side in (0, 1):
            counts = np.diff(whole.ends[side], prepend=0)
            assert np.array_equal(np.bincount(docs[side], minlength=len(texts)), np.where([bool(t) for t in texts], counts, 0))
            assert np.array_equal(ids[side], whole.ids[side][np.repeat([bool(t) for t in texts], counts)])
