"""Training-data operators against brute force, and on odd input: nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import hashlib
import random
import re
import tempfile
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from kgloom.llm import ann, bytesvec, fingerprint, langid, minhash, mixing, pii, queries, secrets, suffix_dedup, toxicity
from kgloom.llm import sentencepiece_lattice as lattice

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, part int"
rng = random.Random(11)
WORDS = ["alpha", "beta", "gamma", "Delta", "naïve", "ÉTÉ", "straße", "x", "12", "mail"]


def prose(n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


BASE = prose(120)
TEXTS = [BASE, BASE, BASE.replace("x", "y", 2), "", None, "one two", prose(80), prose(3000), BASE + " " + prose(10), "a" * 3000, "\u0000 odd ▁ \U0001f600\n\tend"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", None if i == 1 else f"s{i % 3}", len(t or ""), "clash", "clash", 7) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, TEXTS).limit(0)


def test_suffix_order_and_repeats():
    for _ in range(60):
        t = np.array([rng.randrange(rng.choice([1, 2, 26])) + 1 for _ in range(rng.choice([1, 5, 60]))] + [0])
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert suffix_dedup.suffix_order(t, memory=rng.choice([0, 1 << 20]), queue_bytes=rng.choice([0, 1 << 20])).tolist() == want
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(50))) for _ in range(6)]
    counts = Counter(p[i : i + 8] for p in parts for i in range(len(p) - 7))
    assert [x.tolist() for x in suffix_dedup.repeated_starts(parts, 8)] == [[i for i in range(len(p) - 7) if counts[p[i : i + 8]] > 1] for p in parts]


def test_repeated_strings_against_brute_force(docs, empty):
    length = 60
    raw = [(t or "").encode() for t in TEXTS]
    counts = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    rows = {r["id"]: r for r in suffix_dedup.deduplicated(docs, length=length, anchor=20).collect()}
    for i, t in enumerate(raw):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = True
        assert bytes(rows[i]["kept"]) == bytes(np.frombuffer(t, np.uint8)[~gone]), i
        assert rows[i]["n_removed"] == gone.sum() and rows[i]["n_spans"] == (np.diff(np.r_[0, gone.astype(int)]) == 1).sum()
    assert suffix_dedup.deduplicated(empty).count() == 0


def test_texts_are_packed_once_and_powers_follow_need(docs, monkeypatch):
    packs, pack = [], suffix_dedup.packed
    monkeypatch.setattr(suffix_dedup, "packed", lambda d: packs.append(d) or pack(d))
    suffix_dedup.deduplicated(docs, length=60, anchor=20).count()
    assert len(packs) == 1
    monkeypatch.setattr(bytesvec, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    for n in (1, 2, 5, 1000):
        for k, base in enumerate((bytesvec.BASE, bytesvec.BASE_INVERSE)):
            assert bytesvec.powers(n)[k].tolist() == [pow(int(base), i, 1 << 64) for i in range(n)]
            assert len(bytesvec._powers[k]) <= 2 * n


def test_hot_passages_are_split(spark):
    length, anchor, limit = 60, 20, 2000
    made = random.Random(3)
    noise = lambda n: "".join(made.choice("abcdefghij") for _ in range(n))
    hot = [noise(n) for n in (25, 45, 70, 200)]
    texts = [noise(80) + hot[i % 4] + noise(80) for i in range(240)]
    texts += [texts[k][30:] for k in range(8)] + [texts[k][:140] + "zz" for k in range(8, 16)]
    ids = [None if i % 50 == 3 else i for i in range(len(texts))]
    raw = [t.encode() for t in texts]
    counts = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    want = Counter()
    for i, t in zip(ids, raw, strict=True):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = True
        want[i, bytes(np.frombuffer(t, np.uint8)[~gone])] += 1
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    for part_bytes in (1, limit, 1 << 20):
        got = suffix_dedup.deduplicated(docs, length=length, anchor=anchor, part_bytes=part_bytes).collect()
        assert Counter((r["id"], bytes(r["kept"])) for r in got) == want, part_bytes
    at = texts[1].index(hot[1]) + 10
    pieces = []
    for i in range(1, 240, 4):  # all strings that hold one and the same anchor, each in other bytes
        t = raw[i]
        _, h, start, n = suffix_dedup.segments_of(np.array([0, len(t)]), np.frombuffer(t, np.uint8), length, anchor)
        pieces += [(i, int(a) - (1 << 63), 1, int(s), t[s : s + k + length - 1]) for a, s, k in zip(h.tolist(), start.tolist(), n.tolist(), strict=True) if s <= at < s + length]
    key = Counter(p[1] for p in pieces).most_common(1)[0][0]
    one = [p for p in pieces if p[1] == key]
    assert sum(len(p[4]) for p in one) > 2 * limit
    parts, _ = suffix_dedup.split_hot(spark.createDataFrame(one, "id long, anchor long, copies long, start long, bytes binary"), length, anchor, limit)
    sizes = Counter()
    for r in parts.collect():
        sizes[r["anchor"]] += len(r["bytes"])
    assert max(sizes.values(), default=0) <= limit


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_duplicates_against_brute_force(spark, empty):
    texts = list(TEXTS)
    for _ in range(40):  # copies of copies, so that links form chains
        w = (rng.choice(texts[-12:]) or BASE).split()
        for _ in range(rng.randrange(4)):
            if w:
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(9))
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    rows = {r["id"]: r for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert [(rows[i]["n_shingles"], rows[i]["component_id"]) for i in range(len(texts))] == [(len(s), v) for s, v in zip(sets, label, strict=True)]
    assert minhash.near_duplicates(empty).count() == 0


def test_words_whose_sums_of_powers_agree_are_not_alike(spark):
    """The sequence of Thue and Morse and its complement have equal sums for every odd base modulo 2^64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"{word} x y z"), (4, f"{other} x y z")]
    got = {r["id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_parities_differ_in_no_more_bits_than_sets_in_members():
    made = np.random.default_rng(7)
    for _ in range(50):
        base = made.integers(0, 1 << 63, 400, dtype=np.int64).astype(np.uint64)
        a, b = (np.unique(np.concatenate([base, made.integers(0, 1 << 63, int(made.integers(0, 300)), dtype=np.int64).astype(np.uint64)])) for _ in range(2))
        bits = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in minhash.parities(a) ^ minhash.parities(b))
        assert bits <= len(np.setxor1d(a, b)) and (bits > 0 or len(a) == len(b))


def test_near_duplicates_with_repeated_and_null_ids(spark):
    a, b = prose(40), prose(40)
    near = lambda t, w: " ".join([*t.split()[:-1], w])
    rows = [(1, a), (1, b), (2, near(a, "other")), (3, near(b, "other")), (None, near(a, "more")), (None, "x y z"), (7, "x y z"), (None, "p q r"), (None, None), (9, "")]
    got = sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 36, 1), (1, 36, 1), (2, 36, 1), (3, 36, 1), (None, 36, 1), (None, 1, 7), (7, 1, 7), (None, 1, None), (None, 0, None), (9, 0, 9)], key=str)


def test_cross_component_pairs_are_bounded_and_exact(spark):
    facts = spark.createDataFrame([(1, 1, 10, 10, 10), (2, 2, 10, 10, 10), (3, 3, 10, 4, 4), (4, 1, 10, 10, 2)], "rep long, label long, size int, shared long, common long")
    mixed = spark.createDataFrame([(7, r) for r in (1, 2, 3, 4)] + [(8, 1), (8, 2)], "key long, rep long")
    postings = spark.createDataFrame([(r, lab, 10, n, 5) for r, lab, n in ((2, 2, 10), (4, 1, 10))], "rep long, label long, size int, shared long, shingle long")
    assert sorted((r["a"], r["b"]) for r in minhash.cross_edges(mixed, facts, postings).collect()) == [(1, 2), (2, 4)]
    suspects = spark.createDataFrame([(1, 1, 4), (2, 2, 4), (3, 3, 4)], "rep long, label long, size int")
    sets = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 3, 5]), (3, [1, 7, 8, 9])], "rep long, shingles array<long>")
    facts, postings = minhash.shareable(suspects, sets, rare=2, percent=50)
    assert sorted((r["rep"], r["shared"], r["common"]) for r in facts.collect()) == [(1, 3, 1), (2, 3, 1)]
    assert sorted((r["rep"], r["shingle"]) for r in postings.collect()) == [(1, 2), (1, 3), (2, 2), (2, 3)]


def test_fingerprints(docs, empty):
    rows = {r["id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    plain = [fingerprint.canonical(t or "") for t in TEXTS]
    for a in range(len(TEXTS)):
        for b in range(a):
            assert (rows[a] == rows[b]) == (plain[a] == plain[b])
    assert fingerprint.canonical("  ＡB\n ﬁ STRASSE ") == fingerprint.canonical("ab FI straße")
    assert fingerprint.fingerprints(empty).count() == 0


def test_clashing_digests_are_told_apart(spark):
    rows = spark.createDataFrame([(1, "d", "p"), (2, "d", "q"), (3, "e", "p")], "id long, digest string, second string")
    clashes = spark.createDataFrame([("d",)], "digest string")
    assert sorted(r["f"] for r in fingerprint.fingerprinted(rows, clashes, "digest", "second", "f").collect()) == ["d-p", "d-q", "e"]


def test_next_rows(spark, docs):
    """Whole query against brute force: edited texts, and both likenesses."""
    made = random.Random(2)
    texts = [*TEXTS, *(prose(made.randrange(5)) for _ in range(40)), "Same  text", "same TEXT", "abcd", "abc" + "D", "d"]
    order = made.sample(range(0, 900), len(texts))
    rows = [(i, t, 5) for i, t in zip(order, texts, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(5).write.parquet(path := tempfile.mkdtemp() + "/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op10_fingerprints(spark, path.rpartition("/")[0]).collect()}
    in_order = sorted(rows)
    plain = fingerprint.canonical
    for k, (i, t, _) in enumerate(in_order):
        t, u = t or "", in_order[(k + 1) % len(in_order)][1] or ""
        n = len(t) // 4
        new = t[: len(t) - n] + u[:n]
        r = found[i]
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and r["n_chars"] == len(t)
        assert (r["near_edited"], r["near_next"]) == (float(plain(t) == plain(new)), float(plain(t) == plain(u)))
    assert len(found) == len(rows)
    heads = fingerprint.range_heads(docs, np.array([2, 5], np.int64))
    assert sorted(tuple(r) for r in heads.collect()) == [(0, 3), (1, 6), (2, 0)]


SECRETS = 'password = "abcDEF123456"; token: short; secret=token:abcdefghijklmnop AKIA' + "A1" * 8 + " " + "0f" * 10 + " é PASSWD='zzzzzzzzzzzzz'"


def test_secrets_against_brute_force(spark):
    texts = [SECRETS, SECRETS, None, "", "x" * 50 + SECRETS * 3]
    v = spark.createDataFrame([(i, 0, t, "clash") for i, t in enumerate(texts)], "path long, version int, content string, blob string").select("path", "version", "content")
    rows = {r["doc_id"]: r for r in secrets.secret_digest(secrets.findings(v, secrets.scan_blobs(v))).collect()}
    patterns = [r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+"]
    for i, t in enumerate(texts):
        want = []
        for k, (p, g, least) in enumerate(zip(patterns, (2, 0, 0), (12, 18, 16), strict=True)):
            want += [(m.start(), k, m.end()) for m in re.finditer(p, t or "", re.I if k == 0 else 0) if len(m[g]) >= least]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(want))
        assert rows[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and rows[i]["spans"] == said


def test_only_unseen_blobs_and_rules_are_scanned(spark):
    old = spark.createDataFrame([("a", 1, SECRETS)], "path string, version int, content string")
    ledger = secrets.ledger_entries(secrets.scan_blobs(old, secrets.BASE_RULES))
    new = old.union(spark.createDataFrame([("b", 1, "key " + "ab" * 9)], old.schema))
    again = secrets.scan_blobs(new, secrets.BASE_RULES, ledger)
    assert again.count() == 1
    newer = (*secrets.BASE_RULES[:2], secrets.Rule("hex", 2, "[0-9a-f]{16,}", least=16))
    assert sorted(len(r["scanned"]) for r in secrets.scan_blobs(new, newer, ledger).collect()) == [1, 3]


def test_a_second_run_with_a_ledger_equals_a_full_scan(spark):
    old = spark.createDataFrame([("a", 1, SECRETS), ("c", 1, "none")], "path string, version int, content string")
    ledger = secrets.ledger_entries(secrets.scan_blobs(old, secrets.BASE_RULES))
    new = old.union(spark.createDataFrame([("b", 1, "key " + "ab" * 9), ("d", 1, SECRETS), ("e", 1, "ghp_" + "Z" * 36)], old.schema))
    told = lambda found: sorted((r["path"], r["version"], str(r["found"])) for r in found.collect())
    newer = secrets.Rule("hex", 2, "[0-9a-f]{18,}", least=18)
    for rules in (secrets.BASE_RULES, secrets.BASE_RULES + secrets.EXTRA_RULES, (newer, *secrets.BASE_RULES[:2])):
        full = told(secrets.findings(new, secrets.scan_blobs(new, rules)))
        again = secrets.united(ledger.union(ledger), secrets.scan_blobs(new, rules, ledger), rules)
        assert told(secrets.findings(new, again)) == full and len(full) == 5


def test_a_stored_ledger_grows_by_what_is_unseen(spark, tmp_path):
    path = str(tmp_path / "ledger")
    schema = "path string, version int, content string"
    old = spark.createDataFrame([("a", 1, SECRETS), ("c", 1, None), ("c", 2, "")], schema)
    told = lambda found: sorted((r["path"], r["version"], str(r["found"])) for r in found.collect())
    first = told(secrets.scan(old, path))
    entries = secrets.read_ledger(spark, path).count()
    assert first == told(secrets.findings(old, secrets.scan_blobs(old))) and entries == 2 * len(secrets.BASE_RULES + secrets.EXTRA_RULES)
    assert told(secrets.scan(old, path)) == first and secrets.read_ledger(spark, path).count() == entries
    new = old.union(spark.createDataFrame([("b", 1, "key " + "ab" * 9)], schema))
    assert told(secrets.scan(new, path)) == told(secrets.findings(new, secrets.scan_blobs(new)))
    assert secrets.read_ledger(spark, path).count() == entries * 3 // 2
    assert secrets.scan(old.limit(0), path).count() == 0
    many = spark.createDataFrame([("m", 1, "é token=abcdefabcdefab " * 1500)], schema)
    assert [(f["start"], f["stop"]) for f in secrets.scan(many, path).head()["found"] if f["ord"] == 0] == [(23 * k + 2, 23 * k + 22) for k in range(1500)]


def test_personal_data(spark, empty):
    text = "Mail bob.x+1@mail.example.org or 10.0.0.255 and 10.0.0.256, card 4111 1111 1111 1111, call +1 (555) 010-9999. é +12 4111111111111112"
    found = {tuple(text[a:b].strip() for a, b in [(s["start"], s["stop"])]) + (pii.KINDS[s["kind"]],) for s in pii.find(frame(spark, [text])).head()["spans"]}
    assert found == {("bob.x+1@mail.example.org", "email"), ("10.0.0.255", "ip"), ("4111 1111 1111 1111", "card"), ("+1 (555) 010-9999", "phone")}
    for t in ("@" * 50, "a@b@c.d.e", "x@y", "a.b@c-d.e..f", "..@a.b"):
        assert list(pii.emails(t)) == [m.span() for m in pii.EMAIL.finditer(t)]
    assert pii.cleaned("ab cd 12 x9 Bo", [(0, 0, 2), (2, 1, 4), (4, 6, 8), (4, 9, 11), (4, 12, 14)]) == "<EMAIL>d <NUMBER> <CODE> <NAME>"
    assert pii.cleaned("abcdef", [(0, 0, 2), (2, 0, 4)]) == "<CARD>ef"
    assert pii.find(empty).count() == 0


def random_personal(made):
    kinds = ["a.b@c.d", "x@y.z.", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111-1111 1111", "4111111111111112", "12345678901234567890", "+1 555 010 9999", "+12", "++49(0)30-1234567", "é", " ", ".", "-", "word", "7"]
    return "".join(made.choice(kinds) for _ in range(made.randrange(12)))


def test_base_spans_against_the_patterns(spark):
    """The stated patterns themselves, leftmost and not overlapping, on texts made of their fragments."""
    made = random.Random(21)
    texts = [random_personal(made) for _ in range(1500)] + [None, "", "9" * 400, "1.2.3.4 " * 300]
    rows = {r["id"]: r for r in pii.digest(pii.find(frame(spark, texts), terms=False)).collect()}
    digits = lambda x: [int(c) for c in x if c.isdigit()]
    luhn = lambda d: sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(digits(x)) <= 15),
    ]
    for i, t in enumerate(texts):
        want = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if good(m[0])] for k, p, good in rules}
        said = ",".join(x for k in want for x in want[k])
        assert rows[i]["spans"] == said and rows[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), t
        assert [rows[i][f"n_{k}"] for k in want] == [len(v) for v in want.values()]


def test_terms_that_disclose_an_entity(spark):
    """Planted names, numbers and codes far from their address are found wherever they stand; words of all texts are not."""
    made = random.Random(5)
    texts = []
    for i in range(60):
        texts += [f"Zorblax{i} {prose(made.randrange(20, 60))} jane{i}@corp.example.com {prose(30)} ref 77{i:04d} zorblax{i} unit a{i}b" for _ in range(6)]
    texts += [prose(60) for _ in range(300)] + ["only once rare%d mail solo%d@x.example.com" % (i, i) for i in range(20)]
    rows = pii.find(frame(spark, texts)).collect()
    hits = 0
    for r in rows:
        found = {r["text"][s["start"] : s["stop"]].lower() for s in r["spans"] if s["kind"] == 4}
        if r["id"] < 360:
            i = r["id"] // 6
            assert found == {f"zorblax{i}", f"77{i:04d}", f"a{i}b"}, found
            hits += sum(r["text"][s["start"] : s["stop"]].lower() == f"zorblax{i}" for s in r["spans"])
        else:
            assert not found
    assert hits == 720
    cleaned = {r["id"]: r["text"] for r in pii.find(frame(spark, texts), clean=True).collect()}
    assert cleaned[0].startswith("<CODE> ") and cleaned[0].endswith(" <EMAIL> " + texts[0].split("com ")[1].split(" ref")[0] + " ref <NUMBER> <CODE> unit <CODE>") and cleaned[365] == texts[365]


def best_path(text, normal, unknown, byte_ids):
    """By definition, over the whole text: the greatest total of scores in exact numbers, ends settled one by one."""
    s = lattice.MARK + text.replace(" ", lattice.MARK)
    best = [(Fraction(0), [])]
    for stop in range(1, len(s) + 1):
        found = []
        for start in range(stop):
            i, x = normal.get(s[start:stop], (None, unknown))
            if i is not None or stop - start == 1:
                found.append((best[start][0] + Fraction(x), -start, best[start][1] + ([i] if i is not None else [byte_ids[b] for b in s[start:stop].encode()])))
        best.append(max(found)[::2])
    return best[-1][1]


def test_encoding(spark, docs, empty, monkeypatch):
    pieces = lattice.load_pieces(spark)
    for share in (0, 20_000):  # every part by the lattice of rare ones, and by the sample's
        monkeypatch.setattr(lattice, "SAMPLE_DOCS", share)
        rows = {r["id"]: r for r in lattice.encode(docs, pieces).collect()}
        for i, t in enumerate(TEXTS):
            assert rows[i]["decoded"] == (t or "").replace(lattice.MARK, " ")
            if len(t or "") < 2000:
                assert list(rows[i]["ids"]) == (best_path(t, pieces.normal, pieces.unknown, pieces.byte_ids) if t else [])
    assert lattice.encode(empty, pieces).count() == 0
    again = lattice.encode(docs, pieces).select("decoded", lattice.decode_column(pieces)("ids").alias("again")).collect()
    assert all(r["decoded"] == r["again"] for r in again)
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(lattice.MODEL_PATH, "rb").read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    total = lambda ids: sum(model.pieces[i].score for i in ids)
    words = sorted(set(" ".join(t or "" for t in TEXTS[:9]).split()))
    mine = [list(r["ids"]) for r in lattice.encode(frame(spark, words), pieces).orderBy("id").collect()]
    theirs = [library.encode(w) for w in words]
    assert all(total(a) >= total(b) for a, b in zip(mine, theirs, strict=True)) and sum(a == b for a, b in zip(mine, theirs, strict=True)) > 100


def test_long_parts_and_odd_vocabularies(spark):
    """Parts of many windows, pieces longer than a span, characters that only stand in longer pieces."""
    made = random.Random(7)
    names = ["a", "b", "aa", "ab", "ba", "aab", "xy", "a" * 70, lattice.MARK, lattice.MARK + "a", lattice.MARK * 2]
    normal = {p: (300 + k, -float(made.randrange(3, 9) * (5 + len(p)))) for k, p in enumerate(names)}  # whole numbers: sums are exact, ties are ties
    spelt = [bytes([i]) for i in range(256)] + [b""] * 44 + [p.replace(lattice.MARK, " ").encode() for p in names]
    pieces = lattice.pieces_from(normal, spelt, list(range(256)))
    texts = ["".join(made.choice("aab") for _ in range(n)) for n in (1, 63, 64, 65, 128, 129, 700)] + ["a" * 300, "xyx yx  x ", "   ", "aé\na b"]
    rows = {r["id"]: r for r in lattice.encode(frame(spark, texts), pieces).collect()}
    for i, t in enumerate(texts):
        assert rows[i]["decoded"] == t and list(rows[i]["ids"]) == best_path(t, normal, pieces.unknown, list(range(256))), t


def test_mixing_keeps_every_source_within_a_block_of_its_weight(spark, docs, empty):
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05, "e": 0.0}
    share = mixing.shares(weights)
    assert sum(share.values()) == 1 and share["a"] / share["b"] == Fraction(0.5) / Fraction(0.3) and share["e"] > 0
    slots = 100_000
    seen = dict.fromkeys(share, 0)
    for t, (s, i, at, release, due) in enumerate(mixing.schedule(share, {s: int(x * slots) for s, x in share.items()})):
        assert at == t and i == seen[s] and release <= t < due
        seen[s] += 1
        if t % 37 == 0:
            assert all(abs(seen[x] - w * (t + 1)) < 1 for x, w in share.items())
    # Against the weights as they are meant, far from the start.
    assert all(abs(seen[x] - w * (t + 1) * float(1 / (1 + mixing.LEAST))) < 1 for x, w in weights.items() if w)
    alone = mixing.schedule({"a": Fraction(1, 3), "b": Fraction(2, 3)}, {"a": 3, "b": 1})
    assert [x[2] for x in alone if x[0] == "a"] == [x[2] for x in alone if x[0] == "a" and x[3] <= x[2] < x[4]]
    rows = mixing.mix(docs, block_chars=100).collect()
    assert sorted(r["row"]["doc_id"] for r in rows) == list(range(len(TEXTS))) and all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    assert mixing.mixed_order(mixing.mix(docs), 2).columns == docs.columns
    assert mixing.mixed_order(mixing.mix(empty), 2).count() == 0


def test_blocks_grow_with_the_data(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 5)
    rows = mixing.mix(docs, block_chars=1).collect()
    assert len(rows) == len(TEXTS) and max(r["block"] + r["n_blocks"] for r in rows) <= 5


def test_mixing_keeps_every_source_within_a_block_of_characters(spark):
    lengths = [2 + rng.randrange(300) + (4000 if i % 97 == 5 else 0) for i in range(900)]
    rows = [(i, "x" * n, None, "big" if i % 6 else "small") for i, n in enumerate(lengths)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    size, weights = 500, {"big": 3.0, "small": 1.0}
    filled, totals = Counter(), Counter()
    mixed = sorted(mixing.mix(docs, weights, block_chars=size).collect(), key=lambda r: (r["row"]["source"], r["block"], r["n_blocks"]))
    for r in mixed:  # a block is filled by what starts in it, and what goes over into the next
        s, left = r["row"]["source"], len(r["row"]["text"])
        assert totals[s] // size >= r["block"] and r["n_blocks"] >= left / size
        totals[s] += left
        b = r["block"]
        while left:
            part = min(left, size - filled[s, b])
            assert part >= 0 and b < r["block"] + r["n_blocks"]
            filled[s, b] += part
            left -= part
            b += 1
    at = {(s, k): t for s, k, t, _, _ in mixing.schedule(mixing.shares(weights), {s: -(-n // size) for s, n in totals.items()})}
    for s, n in totals.items():
        blocks = -(-n // size)
        assert [filled[s, b] for b in range(blocks)] == [size] * (blocks - 1) + [n - size * (blocks - 1)]
        so_far = 0
        for t, c in sorted((at[s, b], filled[s, b]) for b in range(blocks - 1)):
            assert abs(so_far - t * size * weights[s] / 4) < size
            so_far += c
            assert abs(so_far - (t + 1) * size * weights[s] / 4) < size
    first = {(r["row"]["source"], r["block"]): r["slot"] for r in mixed}
    assert all(t == at[k] for k, t in first.items())


def test_neighbours(spark):
    made = np.random.default_rng(5)
    x = made.normal(size=(600, 16))
    rows = [(i, [float(v) for v in x[i // 2 if i < 20 else i]]) for i in range(600)] + [(600, None), (700, [0.0] * 16), (800, [float("nan")] * 16), (900, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array(v) for i, v in rows[:600]}
    hits = 0
    assert sorted(got) == [0, 100, 200, 300, 400, 500]
    for q, found in got.items():
        want = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]
        hits += len({i for _, i in want} & {i for _, i, _ in found})
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
    assert hits >= 54
    assert ann.search(table.limit(0)).count() == 0


def test_what_is_asked_is_not_broadcast(spark, monkeypatch):
    """Lists of all sizes, in parts: a query has a row for each part it meets and not for each list, and none of them goes through the driver."""
    first, pieces = ann.parts_of(np.array([3000, 1000, 96, 1, 0, 4097, 8193, 5]))
    assert pieces.tolist() == [1, 1, 1, 1, 0, 2, 3, 1] and first.tolist() == [0, 0, 0, 1, 1, 2, 4, 7]
    made = np.random.default_rng(31)
    x = made.normal(size=(1500, 6))
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for chunk in (40, 4096):
        monkeypatch.setattr(ann, "CHUNK", chunk)
        made = ann.search(table)
        plan = made._jdf.queryExecution().sparkPlan().toString().splitlines()
        found[chunk] = sorted(tuple(r) for r in made.collect())
        # Below a join that is broadcast on one side, the other side alone has Python.
        depth = {i: len(line) - len(line.lstrip(" :+-")) for i, line in enumerate(plan)}
        joins = [i for i, line in enumerate(plan) if "BroadcastHashJoin" in line]
        for i in joins:
            below = [j for j in range(i + 1, len(plan)) if all(depth[k] > depth[i] for k in range(i + 1, j + 1))]
            sides = [j for j in below if depth[j] == min(depth[k] for k in below)]
            side = below if len(sides) < 2 else [j for j in below if (j >= sides[1]) == ("BuildRight" in plan[i])]
            assert not any("MapInArrow" in plan[j] or "FlatMapCoGroups" in plan[j] for j in side), plan[i]
    assert found[40] == found[4096]


def test_a_tight_group_smaller_than_k_gets_k_neighbours(spark):
    made = np.random.default_rng(8)
    tight = [made.normal(size=8) * 1e-3 + 50 * np.eye(8)[g % 8] * (1 + g // 8) for g in range(40) for _ in range(9)]
    rows = [(100 * i, [float(v) for v in x]) for i, x in enumerate(tight)]
    got = Counter(r["query_id"] for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == {i: 10 for i, _ in rows}
    few = spark.createDataFrame(rows[:6], "vec_id long, embedding array<double>")
    assert Counter(r["query_id"] for r in ann.search(few).collect()) == {i: 5 for i, _ in rows[:6]}
    index = ann.Index(np.array([[0.0], [100.0], [101.0]]), np.array([[1, 2], [0, 2], [0, 1]]), np.array([0, 1, 2]), 1.3)
    assert index.lists_for(np.array([0.1]), np.array([9, 1, 5]), 11) == [0, 1, 2] and index.lists_for(np.array([0.1]), np.array([9, 9, 5]), 11) == [0, 1]


@pytest.mark.parametrize("fit_rows", [20_000, 1500])
def test_recall_on_many_lists(spark, monkeypatch, fit_rows):
    """Clustered vectors on some 300 lists, fitted by one task and by several: recall, and the share of rows in the lists searched."""
    monkeypatch.setattr(ann, "FIT_ROWS", fit_rows)
    made = np.random.default_rng(12)
    centres = made.normal(size=(400, 24))
    x = centres[made.integers(0, 400, 8000)] + made.normal(size=(8000, 24)) * 0.25
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 8000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        hits += len(got[q] & set([i for i in np.lexsort((np.arange(8000), d)) if i != q][:10]))
    assert hits >= 0.9 * 800
    held = ann.entries(ann.usable(table, "vec_id", "embedding"), 10)
    index = ann.fit(held)
    assert 150 < len(index.centroids) < 700
    lists = index.lists_of(x)
    sizes = np.bincount(np.concatenate(lists), minlength=len(index.centroids))
    owned = np.bincount([a[0] for a in lists], minlength=len(index.centroids))
    compared = [sizes[index.lists_for(x[q], owned, 11)].sum() for q in range(0, 8000, 100)]
    assert np.mean(compared) < 0.1 * 8000


def test_queries_that_lie_elsewhere_than_most_vectors(spark):
    """Tight clusters, and queries apart from all of them: what suffices for a vector of a cluster does not for these."""
    made = np.random.default_rng(21)
    x = (made.normal(size=(150, 16))[made.integers(0, 150, 3000)] + 0.02 * made.normal(size=(3000, 16))).astype(np.float32)
    x[::100] = made.normal(size=(30, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(rows).collect()}
    hit = 0
    for i in range(0, 3000, 100):
        d = ((x.astype(float) - x[i].astype(float)) ** 2).sum(axis=1)
        d[i] = np.inf
        hit += sum((i, int(j)) in got for j in np.argsort(d, kind="stable")[:10])
    assert hit >= 0.9 * 300


def test_languages(spark, docs, empty):
    parts = {"aa": "ba na ka la ma".split(), "bb": "öx üx ßx äx ix".split()}
    texts = [(lang, " ".join(rng.choice(parts[lang]) for _ in range(60))) for lang in parts for _ in range(60)]
    network = langid.train(spark.createDataFrame([*texts, (None, "zzz"), ("aa", None)], "lang string, text string"))
    test = frame(spark, ["ba ka na la ma ba", "üx öx ix ßx", None, "", "1234 !!"])
    assert [r["lang_pred"] for r in langid.predict(test, network).orderBy("id").collect()] == ["aa", "bb", "und", "und", "und"]
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(empty.select("lang", "text"))).collect()} == {"und"}


def brute_segments(scores):
    """Maximal segments by definition: the best one, then those to its left and right."""

    def solve(a, b):
        best = max(((sum(scores[i:j]), -i, -(j - i)) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 1e-12:
            return []
        i, j = -best[1], -best[1] - best[2]
        return [*solve(a, i), (i, j - 1), *solve(j, b)]

    return solve(0, len(scores))


def test_maximal_segments():
    for _ in range(80):
        hits = sorted({rng.randrange(30): rng.choice([0.7, 1.9, 3.3]) for _ in range(6)}.items())
        scores = [-0.6] * 30
        for i, w in hits:
            scores[i] = w
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(hits, -0.6)] == brute_segments(scores)


def test_toxicity(spark, docs, empty):
    texts = [prose(60) + (" vile" + rng.choice("abc") + " rotten" if i % 3 == 0 else "") + prose(10) for i in range(240)]
    table = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    model = toxicity.train(table, labels)
    rows = {r["id"]: r for r in toxicity.score(table, model).collect()}
    assert all((rows[i]["predicted"] == 1) == (i % 3 == 0) for i in range(200, 240))
    passage = rows[201]["passages"][0]
    assert "vile" in texts[201][passage["start"] : passage["stop"]]
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.train(table, labels.limit(0)).fixed == 0.0
    assert toxicity.score(empty, model).count() == 0
