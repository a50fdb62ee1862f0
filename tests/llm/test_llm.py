"""Small tables with nulls, empty and long texts, ties, repeated rows, clashing column names; results against brute force."""

import base64
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stagebook.llm import chat, common, dedup, language, neighbours, quality, similarity, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, lang_pred string, Best int"
SF = "/root/testdata/sf0.001"


def corpus() -> list[tuple]:
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "delta", "été", "straße", "漢字", "x", "!!", "1234"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))
    base = say(120)
    near = [" ".join(w if i not in (7 + k, 80) else f"edit{k}" for i, w in enumerate(base.split(" "))) for k in range(4)]
    texts = [None, "", " \n\t ", "one", "One", "two words", base, base, base.replace(" ", "  "), *near, say(4), say(3000), "  lead", "trail \n", "a" * 3000, "tab\there　wide\xa0x", "<|endoftext|> in text", base + " more"]
    rows = [(k, t, "en" if k % 3 else None, "s", len(t or ""), "d", "p", 1) for k, t in enumerate(texts)]
    return [*rows, rows[6], (None, "no id", "en", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(t):
    return t or ""


def test_byte_bpe_round_trip(docs, none):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    long = [(70, "long words " * 8000 + "z" * 3000)]  # beyond 65,536 characters
    table = docs.select("doc_id", "text", F.lit(1).alias("ids")).unionByName(docs.sparkSession.createDataFrame([(*r, 1) for r in long], "doc_id long, text string, ids int"))
    want = sorted((str(r[0]), np.array(library.encode_ordinary(plain(r[1])), dtype="<u4").tobytes(), plain(r[1]).encode()) for r in [*corpus(), *long])
    for got in (tokens.decode_documents(tokens.encode_documents(table, path, P.PATTERN), path), tokens.recode_documents(table.withColumn("doc_id", F.col("doc_id").cast("int")), path, P.PATTERN)):
        assert sorted((str(r[0]), bytes(r[1]), bytes(r[2])) for r in got.collect()) == want
    assert tokens.encode_documents(none, path, P.PATTERN).count() == 0 and tokens.recode_documents(none, path, P.PATTERN).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, size = Tokenizer.from_file(path), 64
    rows = tokens.pack_documents(docs.where("doc_id <> 6"), path, size=size).collect()
    for r in corpus():
        if r[0] not in (None, 6):
            ids = np.array([*library.encode(plain(r[1]), add_special_tokens=False).ids, 0], dtype="<u4")
            mine = sorted((x for x in rows if x["doc_id"] == r[0]), key=lambda x: x["piece"])
            assert [x["start"] for x in mine] == [sum(y["length"] for y in mine[:k]) for k in range(len(mine))]
            assert [x["ids_crc32"] for x in mine] == [zlib.crc32(ids[x["start"] : x["start"] + x["length"]].tobytes()) for x in mine]
            assert sum(x["length"] for x in mine) == len(ids)
    held = {}
    for x in rows:
        held.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in held.values():
        assert [o for o, _ in sorted(places)] == np.cumsum([0, *[n for _, n in sorted(places)][:-1]]).tolist()
        assert sum(n for _, n in places) <= size
    assert tokens.pack_documents(none, path).count() == 0
    # as few sequences as plain best fit, item by item, and no more than rounding up could save
    free, total = [], sum(x["length"] for x in rows)
    for n in sorted((x["length"] for x in rows), reverse=True):
        best = min((k for k, room in enumerate(free) if room >= n), key=free.__getitem__, default=None)
        if best is None:
            free.append(size - n)
        else:
            free[best] -= n
    assert -(-total // size) <= len(held) == len(free)


def test_plan_places_every_item():
    rng = random.Random(3)
    counts = {n: rng.randrange(1, 9) for n in range(1, 65)}
    plan = tokens.plan_packing(counts, 64)
    fill = {}
    for length, first, end, sequence, per, offset in plan.tolist():
        for k in range(end - first):
            fill.setdefault(sequence + k // per, []).append((offset + k % per * length, length))
    assert sum(map(len, fill.values())) == sum(counts.values())
    for places in fill.values():
        assert [o for o, _ in sorted(places)] == np.cumsum([0, *[n for _, n in sorted(places)][:-1]]).tolist() and sum(n for _, n in places) <= 64


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, at, want = Tokenizer.from_file(path), 0, []
    for r in sorted((r for r in corpus() if r[0] is not None and r[0] != 6), key=lambda r: r[0]):
        ids = np.array([*library.encode(plain(r[1]), add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    written = docs.where("doc_id <> 6").withColumn("doc_id", F.col("doc_id").cast("int")).withColumn("n_tokens", F.lit("x")).withColumn("tokens", F.lit(0))
    tokens.write_token_files(written, lambda: tokens.library_words(path), str(tmp_path / "t"), 1)
    assert sorted(tuple(r) for r in tokens.checked_token_files(spark, str(tmp_path / "t")).collect()) == want
    assert sorted(tuple(r) for r in tokens.read_token_files(spark, str(tmp_path / "t")).collect()) == want
    assert tokens.read_tokens(spark, str(tmp_path / "t"), 3, 5).count() == 3
    tokens.write_token_files(none, lambda: tokens.library_words(path), str(tmp_path / "none"), 1)
    assert tokens.checked_token_files(spark, str(tmp_path / "none")).count() == 0


def test_rows_of_one_id_fill_several_token_files(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    rows = [(7, f"row {k}") for k in range(300)] + [(None, f"none {k}") for k in range(200)] + [(3, "before"), (9, "after")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    tokens.write_token_files(table, lambda: tokens.library_words(path), str(tmp_path / "t"), 1, rows_per_file=40)
    assert len(list((tmp_path / "t").glob("*.parquet"))) >= 8
    got = tokens.checked_token_files(spark, str(tmp_path / "t")).collect()
    spans = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got)
    assert [s for s, _, _ in spans] == np.cumsum([0, *[n for _, n, _ in spans[:-1]]]).tolist()
    ids = [-1 if d is None else d for _, _, d in spans]
    assert ids == sorted(ids) and len(ids) == len(rows)


def test_token_file_format(spark, tmp_path):
    """Encodings, row groups and page indexes of the files, and that a range of ids reads a part of the tokens' pages."""
    import pyarrow.parquet as pq

    path = P.path("word_bpe_49k.json")
    rng = random.Random(5)
    rows = [(k, " ".join(f"{rng.randrange(10**6)}" for _ in range(400))) for k in range(1200)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        tokens.write_token_files(table, lambda: tokens.library_words(path), str(tmp_path / "t"), 1, row_group_mb=1, page_kb=16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    files = [pq.ParquetFile(f) for f in (tmp_path / "t").glob("*.parquet")]
    groups = [f.metadata.row_group(k) for f in files for k in range(f.metadata.num_row_groups)]
    assert len(groups) > 1 and all(g.total_byte_size < 3 << 20 for g in groups)
    by_name = [{g.column(k).path_in_schema: g.column(k) for k in range(g.num_columns)} for g in groups]
    assert {"doc_id", "n_tokens", "ids_crc32"} < set(by_name[0])
    for columns in by_name:
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and not any("DICTIONARY" in e for e in columns["doc_id"].encodings)
        of = next(v for k, v in columns.items() if k.startswith("tokens"))
        assert any("DICTIONARY" in e or "DELTA" in e for e in of.encodings) and of.has_offset_index
        assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index and columns["doc_id"].is_stats_set
    spans = [(c["doc_id"].statistics.min, c["doc_id"].statistics.max) for c in by_name]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))  # row groups follow each other in id order


def test_token_counts_and_overlaps(spark, docs, none):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(11)
    long = [" ".join(rng.choice(["alpha", "été", "漢字", "<unk>", "a\tb", "x" * 40]) for _ in range(20000)), "y" * 70000, "no" + " " * 66000 + "end", "▁" + "word " * 14000]
    table = docs.select("doc_id", "text", F.lit("x").alias("n_tokens")).unionByName(spark.createDataFrame([(900 + k, t, "x") for k, t in enumerate(long)], "doc_id long, text string, n_tokens string"))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(table.withColumn("doc_id", F.col("doc_id").cast("int")), path).collect())
    assert got == sorted((str(d), len(plain(t).encode()), len(library.encode(plain(t)))) for d, t in [*[r[:2] for r in corpus()], *[(900 + k, t) for k, t in enumerate(long)]])
    assert tokens.count_tokens(none, path).count() == 0
    small = tokens.PieceCounter(path, chunk=50, overlap=4)
    for r in corpus():
        assert small.count_long(plain(r[1])) == len(library.encode(plain(r[1])))


def test_exact_dedup(docs, none):
    squeeze = lambda t: "".join(c for c in plain(t) if c not in " \t\n\x0b\x0c\r")
    rows = dedup.duplicate_report(docs).collect()
    for r in rows:
        same = [x for x in corpus() if hashlib.sha256(squeeze(x[1]).encode()).hexdigest() == r["text_sha256"]]
        best = min(same, key=lambda x: (-len(plain(x[1])), -1 if x[0] is None else x[0]))
        assert (r["keep_id"], r["group_size"]) == (best[0], len(same))
    kept = len({squeeze(x[1]) for x in corpus()})
    assert sum(r["kept"] for r in rows) == kept and len(rows) == len(corpus())
    out = dedup.drop_duplicates(docs)
    assert out.columns == docs.columns and out.count() == kept
    assert dedup.duplicate_report(none).count() == 0


def exchanged(df):
    """Names of the columns that pass through an exchange of rows (adaptive planning is off)."""
    out, todo = set(), [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            out |= {node.output().apply(k).name() for k in range(node.output().size())}
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return out


def test_texts_are_never_shuffled_however_many_keys_survive(spark, docs, monkeypatch):
    seen, write = [], dedup.materialize

    def noted(df, tag):
        seen.append(exchanged(df))
        return write(df, tag)

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)  # as if all keys were too many to broadcast
    monkeypatch.setattr(dedup, "materialize", noted)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        report = dedup.duplicate_report(docs)
        seen.append(exchanged(report))
        assert len({r["text_sha256"] for r in report.collect() if r["kept"]}) == report.where("kept").count() == dedup.drop_duplicates(docs).count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert seen and set().union(*seen) and not {"text", "norm"} & set().union(*seen)


def test_of_copies_alike_in_key_one_row_stays(spark):
    rows = [(1, "a b", "y"), (1, "a b", "x"), (1, "ab", "z"), (2, "a  b", "w"), (2, "a  b", "v"), (None, "c", "u"), (None, "c", "t"), (3, "d", "s")]
    out = sorted(r["source"] for r in dedup.drop_duplicates(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect())
    assert out == ["s", "t", "v"]


def test_prefixes_are_hashed_for_repeated_lengths_alone(spark, monkeypatch):
    seen, steps, write = spark.sparkContext.accumulator(0), {}, dedup.materialize
    hashed = F.udf(lambda x: seen.add(1) or zlib.crc32(x.encode()), "long")

    def noted(df, tag):
        out = write(df, tag)
        steps[tag] = seen.value
        return out

    monkeypatch.setattr(dedup, "_prefix_hash", lambda norm: hashed(F.substring(norm, 1, dedup.PREFIX)))
    monkeypatch.setattr(dedup, "materialize", noted)
    docs = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc"), (4, "ddd"), (5, "c cc"), (6, "eeeee")], "doc_id long, text string")
    got = dedup.refine(docs)
    assert steps["lengths"] == 0 and steps["survivors"] == 3
    assert [(r["group_size"], r["best"]["doc_id"]) for r in got.groups.collect()] == [(2, 5)]


def test_chat_reads_back(spark):
    rows = [(1, 2, "assistant", r"a \e <b> ### c </turn>"), (1, 1, "user", "hi\n"), (1, 3, "assistant", None), (2, 1, None, "x"), (2, 1, "sys:tem\n", "y"), (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    rows += [(3, k, "assistant" if k % 3 else "user", f"turn {k} " + "<#\\" * (k % 4)) for k in range(1500)] + [(4, 1, "assistant", "long " * 20000), (4, 1, "assistant", "long " * 20000), (None, None, None, None)]
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, turns int, pieces string, blocks string")
    got = {r["conv_id"]: r for r in chat.read_conversations(chat.format_conversations(table)).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        turns = sorted((-1 if t is None else t, plain(a), plain(x)) for k, t, a, x in rows if k == c)
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(a, x) for _, a, x in turns]
        assert r["loss_texts"] == [x for _, a, x in turns if a == "assistant"]
    assert chat.read_conversations(chat.format_conversations(table.limit(0))).count() == 0


def jaccard_components(rows):
    """Brute force: (id as text, size of the set, smallest id of the component) of every row."""
    import re

    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", plain(r[1]).translate(lower))
        sets.append((r[0], {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    label = list(range(len(sets)))
    for _ in sets:
        for i, (_, a) in enumerate(sets):
            for j, (_, b) in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    first = {k: min((sets[i][0] for i in range(len(sets)) if label[i] == k and sets[i][0] is not None), default=None) for k in set(label)}
    return [(str(d), len(s), first[label[i]]) for i, (d, s) in enumerate(sets)]


def found_components(docs, **kw):
    return sorted(((str(r[0]), r[1], r[2]) for r in similarity.similar_documents(docs, **kw).collect()), key=lambda r: (r[0], r[1], str(r[2])))


def same(got, want):
    return got == sorted(want, key=lambda r: (r[0], r[1], str(r[2])))


def test_jaccard_links(docs, none):
    assert same(found_components(docs.withColumn("doc_id", F.col("doc_id").cast("int"))), jaccard_components(corpus()))
    assert similarity.similar_documents(none).count() == 0 and similarity.drop_similar(none).count() == 0
    out = similarity.drop_similar(docs)
    assert out.columns == docs.columns and out.where("doc_id = 6").count() == 1


def chain(n, step, rng):
    """Texts of which neighbours alone are similar: each replaces some words of the last."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    out = []
    for k in range(n):
        for j in range(step):
            words[(k * step + j) * 7 % 150] = f"n{k}x{j}"
        out.append(" ".join(words))
    return out


def test_rows_without_ids_link_and_bridge(spark):
    a, b, c = chain(3, 2, random.Random(4))
    rows = [(1, a), (None, b), (2, c), (None, "alone without any id at all here"), (7, "x y"), (None, "x y"), (None, "p q r"), (None, "p q r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert same(found_components(docs), jaccard_components(rows))
    assert any(r[0] == "None" and r[2] == 1 for r in jaccard_components(rows))
    kept = sorted((str(r[0]), r[1]) for r in similarity.drop_similar(docs).collect())
    assert kept == sorted([("1", a), ("None", "alone without any id at all here"), ("7", "x y"), ("None", "p q r")])


def test_a_hot_shingle_and_long_lists_in_pieces(spark):
    """A passage that all share is most of each text; lists are split so small that every step works on pieces."""
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{passage} {' '.join(f'q{rng.randrange(40)}' for _ in range(10 + k % 5))}") for k in range(60)]
    rows += [(100 + k, t) for k, t in enumerate(chain(12, 3, rng))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = jaccard_components(rows)
    assert len({r[2] for r in want}) < len(rows)
    assert same(found_components(docs, split=3), want)


def test_similar_rows_of_one_id(spark):
    """Copies under one id are one; a text that is like no other stays, whatever else has its id."""
    a, b, *_ = chain(3, 2, random.Random(8))
    rows = [(5, a, "s1"), (5, a, "s2"), (5, "like nothing else that is here", "s3"), (9, b, "s4"), (9, "nor is this one like any", "s5"), (11, "", "s6"), (11, "", "s7")]
    out = sorted(r["source"] for r in similarity.drop_similar(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert out == ["s1", "s3", "s5", "s6", "s7"]


def test_divide_skip_against_counting():
    rng = np.random.default_rng(1)
    query = np.unique(rng.integers(0, 400, 150, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(query, k, replace=False), rng.integers(400, 900, 20, dtype=np.uint64)])) for k in range(60, len(query), 3)]
    want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(query, s)) >= 80 * len(np.union1d(query, s))]
    for weight in (0.0, 0.0085, 1.0, 100.0):  # from all long lists that T allows to none
        assert sorted(similarity.divide_skip(query, similarity.Lists(sets), weight)) == want and want
    assert similarity.divide_skip(query, similarity.Lists([])) == [] and similarity.divide_skip(query[:0], similarity.Lists(sets)) == []


def test_a_group_of_near_copies_is_found_from_long_lists():
    """One search finds a group from its lists: some entries are merged, the long lists are probed."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    group = [np.unique(np.concatenate([np.delete(base, rng.choice(200, 8, replace=False)), rng.integers(0, 2**63, 5, dtype=np.uint64)])) for _ in range(80)]
    others = [np.unique(np.concatenate([base[:60], rng.integers(0, 2**63, 140, dtype=np.uint64)])) for _ in range(40)]
    seen = {}
    links = similarity.stars([*group, *others], seen)
    assert len({x for link in links for x in link}) == 80 and all(max(link) < 80 for link in links)
    assert seen["longest"] >= 100 and seen["merged"] > 1000 and seen["skipped"] > 100 and seen["probes"] > 1000


def test_equal_rows_give_one_set(spark):
    a, b, *_ = chain(2, 2, random.Random(6))
    rows = [(5, a, "x.y")] * 60 + [(6, b, "z"), (7, a, "z"), (None, b, "z"), (None, b, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    signed = common.materialize(similarity.signatures(docs), "signed")
    classes = signed.groupBy("s1", "s2", "n").agg(F.min("row").alias("rep"), F.min("doc_id").alias("first"))
    assert similarity.survivor_sets(docs, similarity.survivors(signed, classes), signed).count() == 2
    assert same(found_components(docs), jaccard_components(rows))
    assert similarity.drop_similar(docs).count() == 1


def vectors_and_answers(k=20):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 16)))]
    rows += [(200, [0.0] * 16), (220, None), (240, [float("nan")] * 16), (260, [1.0] * 15 + [None]), (280, [1.0] * 9), (None, [1.0] * 16), (300, rng.normal(size=16).tolist())]
    rows += [(400 + i, rows[5][1]) for i in range(30)] + [rows[40], rows[40], rows[7]]
    usable = [(i, np.array(v)) for i, v in rows if i not in (None, 200, 220, 240, 260, 280)]
    want = []
    for q, v in usable:
        if q % 20 == 0:
            best = sorted(((-float((v * x).sum()), i) for i, x in usable if i != q))[:k]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return rows, sorted(want)


@pytest.mark.parametrize("block", [None, 64])
def test_neighbours(spark, monkeypatch, block):
    """All blocks of one size and many small cells; odd vectors, repeated rows, ties, a table with other columns of the same names."""
    if block:
        monkeypatch.setattr(neighbours, "CANDIDATES", block)
        monkeypatch.setattr(neighbours, "QUERIES", 5)
    rows, want = vectors_and_answers()
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id int, embedding array<double>, id int, v string, row int")
    got = sorted(tuple(r) for r in neighbours.nearest(table).collect())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12, atol=1e-12)
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_neighbours_of_very_large_and_tiny_vectors(spark):
    """Products that overflow are infinite and tie, those that only their parts overflow are found, tiny ones too."""
    rng = np.random.default_rng(8)
    rows = [(k, (rng.standard_normal(8) * 1e160).tolist()) for k in range(60)] + [(60 + k, (rng.standard_normal(8) * 1e-170).tolist()) for k in range(20)]
    rows += [(80, [1e200, 1e200, 1.0] + [0.0] * 5), (81, [1e200, -1e200, 1.0] + [0.0] * 5), (82, [1.7e308] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(table, every=20, k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    vec = {k: [Fraction(x) for x in v] for k, v in rows}
    for q in range(0, 83, 20):
        exact = {v: sum(x * y for x, y in zip(vec[q], vec[v], strict=True)) for v in vec if v != q}
        double = lambda x: float("inf") * (1 if x > 0 else -1) if abs(x) >= 2**1024 else float(x)
        want = sorted(exact, key=lambda v: (-double(exact[v]), v))[:10]
        mine = sorted(got[q])
        assert len(mine) == 10
        for (_, v, s), w in zip(mine, want, strict=True):
            assert s == pytest.approx(double(exact[w]), rel=1e-12, abs=1e-320)
            assert double(exact[v]) == pytest.approx(double(exact[w]), rel=1e-12, abs=1e-320)


def test_stages_take_columns_with_dots_and_empty_tables(spark):
    rows = [(k, f"the quick brown fox number {k} jumps over that lazy dog again" if k % 2 else f"el rapido zorro marron numero {k} salta sobre aquel perro", "en" if k % 2 else "es", "v", "w") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` string, `Lang_Score` string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    for stage in (language.keep_identified, lambda d: quality.keep_good(d, labels), dedup.drop_duplicates, similarity.drop_similar):
        out = stage(docs)
        assert out.columns == docs.columns and {r["a.b"] for r in out.collect()} == {"v"}
        assert stage(docs.limit(0)).count() == 0


def test_long_conversations_read_back(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", f"# turn {k} " + "é漢😀<" * (k % 40)) for k in range(6000)]
    back = chat.read_conversations(chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).first()
    assert back["loss_texts"] == [t for _, k, _, t in turns if k % 2] and [t["text"] for t in back["turns"]] == [t for *_, t in turns]


def kept_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_quality_against_a_plain_discriminant(spark, docs, none):
    """The same statistics, a discriminant by inverses and determinants; accuracy on held-out rows alone."""
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [(r["doc_id"], r["text"]) for r in table.collect()] + [(None, None), (10**6, "")]
    x = []
    for _, t in rows:
        raw = np.frombuffer(plain(t).encode(), dtype=np.uint8)
        x.append(quality.statistics(raw, np.array([0, len(raw)]))[0])
    x = np.array(x)
    y = np.array([-1 if d not in truth or kept_out(d) else truth[d] for d, _ in rows])
    groups = [x[y == k] for k in (0, 1)]
    cov = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, cov, strict=True)) / sum(map(len, groups)) + 1e-3 * np.eye(x.shape[1])
    density = []
    for g, c in zip(groups, cov, strict=True):
        c, z = 0.8 * c + 0.2 * pooled + 1e-3 * np.eye(x.shape[1]), x - g.mean(axis=0)
        density.append(np.log(len(g) / sum(map(len, groups))) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * np.einsum("ij,ij->i", z @ np.linalg.inv(c), z))
    want = {d: v for (d, _), v in zip(rows, 1 / (1 + np.exp(-np.clip(0.25 * (density[1] - density[0]), -60, 60))), strict=True)}
    odd = spark.createDataFrame(rows[-2:], "doc_id long, text string")
    wide = table.select("doc_id", "text").unionByName(odd).withColumn("x", F.lit("x")).withColumn("y", F.lit(0)).withColumn("score", F.lit(1))
    got = quality.score_documents(wide, labels.withColumn("x", F.lit(0))).collect()
    assert len(got) == len(rows)
    assert np.allclose([r["score"] for r in got], [want[r["doc_id"]] for r in got], atol=1e-6)
    assert all(r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == kept_out(r["doc_id"]) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 5 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
    assert quality.score_documents(docs, labels.limit(0)).count() == docs.count()
    assert quality.score_documents(none, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_language_against_plain_votes(spark, docs, none):
    """Byte pairs counted one by one and machines asked one by one give the same; accuracy on held-out rows alone."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    long = spark.createDataFrame([(10**6, "the long and short of it " * 4000, "en"), (None, "1234 !!", "en"), (10**6 + 1, "", None)], "doc_id long, text string, lang string")
    table = table.select("doc_id", "text", "lang").unionByName(long)
    model = language.fit_languages(table)
    names = sorted(v for of in model.languages.values() for v in of)
    assert names == sorted({r["lang"] for r in table.collect() if r["lang"] and not kept_out(r["doc_id"])})
    out = {r["doc_id"]: r for r in language.identify_languages(table.withColumn("lang_pred", F.lit(1)).withColumn("pair", F.lit(2))).collect()}

    def vote(text, names):
        raw = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode())
        share = {}
        for a, b in zip(raw, raw[1:], strict=False):
            share[a * 256 + b] = share.get(a * 256 + b, 0) + 1 / (len(raw) - 1)
        won = dict.fromkeys(names, 0.0)
        for (one, other), (weights, bias) in model.machines.items():
            if one in won and other in won:
                p = 1 / (1 + np.exp(-np.clip(4 * (sum(weights[model.place[k]] * v for k, v in share.items()) + bias), -60, 60)))
                won[one] += p
                won[other] += 1 - p
        return max(names, key=won.get)

    right = total = 0
    for r in table.collect():
        got = out[r["doc_id"]]
        if not any(c.isalpha() for c in plain(r["text"])):
            assert (got["lang_pred"], got["score"]) == ("und", 0)
            continue
        assert got["lang_pred"] == vote(r["text"], model.languages[vote(r["text"], sorted(model.languages))]) and 0 <= got["score"] <= 1
        assert got["held_out"] == kept_out(r["doc_id"])
        if got["held_out"] and r["lang"]:
            right, total = right + (got["lang_pred"] == r["lang"]), total + 1
    assert total > 10 and right >= 0.95 * total
    close = [r for r in table.collect() if r["lang"] in ("en", "de") and kept_out(r["doc_id"]) and r["doc_id"] is not None]
    assert language.family("en") == language.family("de") and {r["lang"] for r in close} == {"en", "de"}
    assert sum(out[r["doc_id"]]["lang_pred"] == r["lang"] for r in close) >= 0.95 * len(close)
    odd = {r["doc_id"]: r for r in language.identify_languages(docs).collect()}
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == "und" and odd[0]["score"] == 0
    assert language.identify_languages(none).count() == 0 and language.keep_identified(docs).columns == docs.columns


def test_pipeline_against_brute_force(spark, tmp_path):
    """All five stages over a table with nulls, repeated rows and more columns; copies and pieces are checked one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.where("doc_id < 60").cache()
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (10**6, " \n", "en", None, 2)], docs.schema)
    table = some.unionByName(some.where("doc_id < 9")).unionByName(some.where("doc_id < 4").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd)
    table.withColumn("digest", F.lit("d")).withColumn("row", F.lit(1)).withColumn("length", F.lit(2)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    at, steps = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = at.columns
    for name, stage in corpus_pipeline.STAGES:
        before = at.collect()
        at = common.materialize(stage(spark, at, str(tmp_path)), "test")
        steps[name] = before, at.collect()
        assert name == "packing" or at.columns == columns
    for before, after in list(steps.values())[:2]:
        assert 0 < len(after) < len(before)
    before, after = steps["exact_dedup"]
    squeeze = lambda t: "".join(c for c in plain(t) if c not in " \t\n\x0b\x0c\r")
    assert sorted(squeeze(r["text"]) for r in after) == sorted({squeeze(r["text"]) for r in before})
    before, after = steps["near_dedup"]
    parts_of = jaccard_components([(r["doc_id"], r["text"]) for r in before])
    groups = {(c, n) if c is None else c for _, n, c in parts_of}
    assert len(after) == len(groups) and {r["doc_id"] for r in after if r["doc_id"] is not None} == {c for _, _, c in parts_of if c is not None}
    before, pieces = steps["packing"]
    held = {}
    for r in pieces:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in v) <= 2048 and [o for o, _ in sorted(v)] == [sum(n for o2, n in v if o2 < o) for o, _ in sorted(v)] for v in held.values())
    assert sum(r["piece"] == 0 for r in pieces) == len(before)


def test_word_ids_are_the_tokenizers():
    """Every piece of the vocabulary, odd spaces, marks, and characters that the two libraries may class differently."""
    encoder = tokens.library_words(P.path("word_bpe_49k.json"))
    assert encoder.direct
    back = {c: b for b, c in tokens.byte_letters().items()}
    texts = [bytes(back[c] for c in v.removesuffix("</w>")).decode(errors="replace") for v in encoder.whole.get_vocab() if "|" not in v]
    texts += [f"a{chr(c)}B" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    draw = random.Random(3)
    texts += ["".join(draw.choices("aAbé ’'sß́\n\t  .!?0१İ😀東\x00\x1d ՘", k=draw.randrange(40))) for _ in range(3000)]
    texts += ["", " ", "a  b", "x<|endoftext|>y"]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.whole.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode_batch(texts) == want


def test_word_encoder_with_a_small_pool_special_strings_and_wide_spaces():
    encoder = tokens._LibraryWords(P.path("word_bpe_49k.json"))
    encoder.entries = 8  # the pool turns over with each batch
    batches = [
        ["", " ", "one two  three\n", "one"], ["caf\u00e9 \u00a0 x\u00a0y z", "\u00c9t\u00e9\u3000a \u0130stanbul", "e\u0301 \u0301 q"], ["a <|endoftext|> b", "one two", "<|startoftext|>"],
        ["one\ttwo\x00 \x1c three", "\u4e2d\u6587 \U0001f600", ""], ["<|endoftext|>"], ["word " * 5000 + "x" * 300],
    ]
    for texts in batches:
        want = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.whole.encode_batch(texts, add_special_tokens=False)]
        assert encoder.encode_batch(texts) == want
    flat, counts = encoder.encode_column(tokens.pa.array([None, "one two", None], tokens.pa.string()).slice(1))
    assert counts.tolist() == [2, 0] and len(flat) == 2
