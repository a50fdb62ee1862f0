"""Spelling variants, SimHash links and the Merkle manifest against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stagebook.llm import manifest, queries, simhash, variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, `a.b` int, Print long, Word string"


def frame(spark, rows):
    """Rows of (doc_id, text, source), with other columns that clash with names inside the operators."""
    return spark.createDataFrame([(d, t, "en" if (d or 0) % 2 else None, s, len(t) if t else None, "k", 1, 2, "w") for d, t, s in rows], SCHEMA)


# ---------------------------------------------------------------- 11


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows, every=31, shortest=7, least=2):
    counts = Counter()
    for d, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d}:{w}".encode())
            if d is not None and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= shortest and k >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 10 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def variant_rows():
    rng = random.Random(3)
    base = ["spelling", "variants", "Éclairage", "straßenname", "aaaaaaaa", "abababab", "grouping"]
    said = []
    for w in base:
        said += [w] * 240 + [w[:4] + w[5:]] * 12 + [w[:2] + "q" + w[3:]] * 23 + [w[:2] + "q" + w[3:-1]] * 2 + [w + "s"] * 2 + [w[1:]] * 2
    for _ in range(400):  # a dense neighbourhood that shares beginnings and ends
        said.append("prefix" + "".join(rng.choice("ab") for _ in range(4)) + "end")
    said += ["short", "x", "ÀÿÀÿÀÿÀ", "ÀÿÀÿÀÿÁ"] * 3 + ["twice×twice÷", "Spelling", "SPELLING"] * 2 + ["z" * 2000] * 2 + ["z" * 2001] * 2
    rng.shuffle(said)
    rows = [(k, ", ".join(said[k::90]), "s") for k in range(90)] + [(None, "spelling spellinng, spellinng", None), (5, None, "s"), (6, "", "s"), (7, "1234 !!", "s")]
    return [*rows, rows[3]]


@pytest.mark.parametrize("limit", [variants.LIST_WORDS, 3])
def test_spelling_variants(spark, limit):
    """A limit of three halves nearly every list down to windows of one place."""
    rows = variant_rows()
    want = plain_variants(rows)
    got = variants.spelling_variants(frame(spark, rows), limit=limit)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == want
    assert sum(r[1] is not None for r in want) > 10 and any(r[2] != r[1] for r in want if r[1])


def test_spelling_variants_of_nothing(spark):
    assert variants.spelling_variants(frame(spark, []).limit(0)).count() == 0
    assert variants.spelling_variants(frame(spark, [(1, None, "s"), (2, "few short words", "s")])).count() == 0


def test_sorted_scan_against_all_pairs():
    rng = random.Random(1)
    for _ in range(1500):
        words = sorted({"".join(rng.choice("abcé"[: rng.choice([2, 4])]) for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 60))})
        want = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and one_edit(a, b)]
        assert list(variants.one_edit_apart(words)) == want


# ---------------------------------------------------------------- 12


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_links(ids, prints, most=2):
    label = list(range(len(ids)))
    links = [(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints) if i < j and (a ^ b).bit_count() <= most]
    moved = True
    while moved:
        moved = False
        for i, j in links:
            low = min(label[i], label[j])
            moved |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    first = {}
    for d, l in zip(ids, label, strict=True):
        first[l] = min((x for x in (first.get(l), d) if x is not None), default=None)
    return [first[l] for l in label]


def near_texts():
    """Long texts and some edits of theirs, nulls, empty and short texts, repeated rows."""
    rng = random.Random(5)
    say = lambda n: [rng.choice(["Alpha", "beta", "gämma", "漢字"]) + str(rng.randrange(200)) for _ in range(n)]
    texts = [None, "", " \n\t", "one", "ONE", "one two", "one　two wide", "a b c", "A  B\tC"]
    for _ in range(6):
        words = say(400)
        texts.append(" ".join(words))
        for _ in range(8):
            words = words.copy()
            words[rng.randrange(400)] = "edit"
            texts.append("\n".join(words))
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    return [*rows, rows[12], (None, texts[12], None), (None, "nothing like it at all", None), (900, None, None)]


@pytest.mark.parametrize("limit", [simhash.AT_HOME, 2])
def test_simhash_links(spark, limit):
    rows = near_texts()
    prints = [plain_print(t) for _, t, _ in rows]
    assert all(simhash.fingerprint(t) == p for (_, t, _), p in zip(rows, prints, strict=True))
    firsts = plain_links([d for d, _, _ in rows], prints)
    want = sorted((str(d), f"{p:016x}", str(c)) for (d, _, _), p, c in zip(rows, prints, firsts, strict=True))
    got = simhash.near_duplicates(frame(spark, rows).withColumn("doc_id", F.col("doc_id").cast("int")), limit=limit)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got.collect()) == want
    assert 10 < len(set(firsts)) < len(set(prints))


@pytest.mark.parametrize("limit", [simhash.AT_HOME, 3])
def test_prints_in_crowds(spark, limit):
    """Fingerprints drawn near few centres, so that anchors are home to many: every pair is found, and none beyond."""
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in centres.tolist():
        for _ in range(60):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "print long")
    got = {(r["a"], r["b"]) for r in simhash.linked_prints(table, limit=limit).collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want and len(want) > 200


def test_covering_code():
    x = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    home = simhash.homes(x)
    row, words = simhash.anchors(x)
    for part in simhash.covering_code():
        assert (part.syndromes(home) == 0).all() and (part.syndromes(words) == 0).all()
    assert np.bitwise_count(home ^ x).max() <= 14 and np.bitwise_count(words ^ x[row]).max() <= 16
    for a in range(64):
        for b in (a, (a * 7 + 5) % 64):  # a neighbour within two bits visits the home
            y = x[:8] ^ np.uint64(1 << a) ^ np.uint64(1 << b if a != b else 0)
            row, words = simhash.anchors(y)
            for k in range(8):
                assert home[k] in words[row == k] or simhash.homes(y)[k] == home[k]


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(frame(spark, []).limit(0)).count() == 0


# ---------------------------------------------------------------- 13


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root and, for each leaf, the steps (place, siblings) of its proof."""
    nodes, steps, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            run = nodes[a - a % 3 : a - a % 3 + 3]
            steps[k].append((a % 3, [n for p, n in enumerate(run) if p != a % 3]))
        nodes = [sha(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        at = [a // 3 for a in at]
    return nodes[0], steps


def plain_manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    says = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(*map(says, (*r[:4], text)))
    by = defaultdict(list)
    for r in rows:
        shown = r[4]
        if r[0] is not None and shown is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
            shown = shown.replace("\n", "")
        by[r[1]].append((leaf(r, r[4]), leaf(r, shown), r[0]))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[2] is not None, x[2] or 0, x[0]))
    inner = {s: plain_tree([x[0] for x in by[s]]) for s in order}
    root, outer = plain_tree([inner[s][0] for s in order]) if order else (None, [])
    out = []
    for s, above in zip(order, outer, strict=True):
        for (own, shown, d), steps in zip(by[s], inner[s][1], strict=True):
            node = shown
            for place, others in (*steps, *above):
                node = sha(*others[:place], node, *others[place:])
            out.append((str(d), own, inner[s][0], root, sha(*(o for _, others in (*steps, *above) for o in others)), node, node == root))
    return sorted(out)


def manifest_rows():
    rng = random.Random(2)
    rows = []
    for source, n in (("hot", 100), ("one", 1), (None, 5), ("", 4), ("zz", 27), ("é", 28), ("hot2", 10), ("b", 2), ("c", 2), ("d", 9)):
        rows += [(rng.randrange(10**6) - 1000, f"line {k}\nand {source}\n" * (k % 3), source) for k in range(n)]
    return [*rows, rows[0], rows[0], (rows[1][0], "another text\n", "hot"), (None, "no id\n", "hot"), (None, None, None), (17, None, "hot"), (17, "", "hot")]


@pytest.mark.parametrize("depth", [manifest.DEPTH, 1])
def test_manifest(spark, depth):
    """With blocks of three leaves the exchange takes several rounds, with ragged runs."""
    rows = manifest_rows()
    table = frame(spark, rows)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = manifest.document_manifest(table, F.when(chosen, F.translate("text", "\n", "")), depth)
    folded = manifest.fold(F.col("shown"), F.col("proof"))
    proof = F.sha2(manifest.siblings(F.col("proof")).cast("binary"), 256)
    found = got.select("doc_id", "leaf", "subroot", "root", proof, folded.alias("f"), (folded == F.col("root")).alias("v")).collect()
    want = plain_manifest([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in table.collect()])
    assert sorted((str(r[0]), *r[1:]) for r in found) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("n", range(1, 30))
def test_butterfly_of_any_number_of_blocks(spark, n):
    leaves = [sha(str(k)) for k in range(n)]
    root, steps = plain_tree(leaves)
    if n % 4 == 1 or n in (2, 3, 9, 10, 27, 28):
        blocks = spark.createDataFrame([("g", k, n, x) for k, x in enumerate(leaves)], "key string, block long, blocks long, node string")
        got = {r["block"]: r for r in manifest.butterfly(blocks).collect()}
        for k in range(n):
            assert got[k]["top"] == root
            assert [(p["place"], p["siblings"]) for p in got[k]["proof"]] == [(a, "".join(o)) for a, o in steps[k]]


def test_manifest_of_nothing(spark):
    assert manifest.document_manifest(frame(spark, []).limit(0)).count() == 0


def test_queries_of_these_operators(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs]
    known = queries.queries()
    got = known["op11_spelling_variants"](spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == plain_variants(rows)
    prints = [plain_print(t) for _, t, _ in rows]
    want = sorted((d, f"{p:016x}", c) for (d, _, _), p, c in zip(rows, prints, plain_links([r[0] for r in rows], prints), strict=True))
    assert sorted(tuple(r) for r in known["op12_simhash"](spark, sf).collect()) == want
    want = plain_manifest([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs])
    assert sorted((str(r[0]), *r[1:]) for r in known["op13_merkle_manifest"](spark, sf).collect()) == want
