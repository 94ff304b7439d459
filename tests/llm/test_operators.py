"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n_words long, bucket string, word string, kept string"
ODD = [None, "", " \n\t ", "a", "a b c d", "a b c d e", "A B C D E", "x " * 3000, "é 日本 🎉\x0b\x1c b", "w" * 20000, "one two three four five six\none two three four five six\n"]


def table(spark, texts, first=0):
    rows = [(first + i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], None, 1, 2, "q", "w", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """The odd texts, one row repeated, and two rows without an id."""
    docs = table(spark, ODD + ["p q r s t u v w"] * 2)
    return docs.unionByName(docs.where("doc_id = 4")).unionByName(docs.where("doc_id in (3, 5)").withColumn("doc_id", F.lit(None).cast("long")))


def random_texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(60)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        texts.append(" ".join(words))
    return texts


# -- op1 -------------------------------------------------------------------------------------


def test_mixing_targets_and_bounds(spark):
    from attesta.llm.mixing import mix, mixed_documents

    texts = [" ".join(["w"] * (1 + i % 40)) for i in range(900)]
    docs = table(spark, texts + ODD)
    rows = mix(docs).collect()
    assert len(rows) == len(texts) + len(ODD)
    again = {(r.doc_id, r.taken) for r in mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    by = collections.defaultdict(lambda: [0, 0, None, 0])
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        assert r.taken in (0, r["size"], 2 * r["size"])
        b = by[source[r.doc_id]]
        b[0], b[1], b[2], b[3] = b[0] + r["size"], b[1] + r.taken, r.target, r.source_size
    total = sum(b[0] for b in by.values())
    assert abs(sum(b[2] for b in by.values()) - 1.5 * total) < 1e-6
    for size, taken, target, said in by.values():
        assert size == said and target <= 2 * size + 1e-9
        assert abs(taken - target) <= 0.05 * size + 40
    copies = mixed_documents(docs).groupBy("doc_id").count().collect()
    times = {r.doc_id: r.taken // r["size"] for r in rows if r["size"]}
    assert {r.doc_id: r["count"] for r in copies if r.doc_id in times} == {k: v for k, v in times.items() if v}
    assert mixed_documents(docs).columns == docs.columns


def test_mixing_water_filling(spark):
    from attesta.llm.mixing import targets

    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 40)], "source string, source_size long")
    got = {r.source: r.target for r in targets(sizes, (3, 1, 2), 150, 2).collect()}
    weights, caps, budget = {"a": 3, "b": 1, "c": 2, None: 3}, {"a": 20, "b": 2000, "c": 1000, None: 80}, 1550 * 1.5
    want, open_ = {}, set(weights)
    while True:
        left = budget - sum(want.values())
        over = [s for s in open_ if left * weights[s] / sum(weights[o] for o in open_) > caps[s]]
        if not over:
            want |= {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
            break
        for s in over:
            want[s] = caps[s]
            open_.remove(s)
    assert got == pytest.approx(want)


def test_mixing_empty_and_odd(spark):
    from attesta.llm.mixing import mix

    docs = odd(spark)
    assert mix(docs.limit(0)).count() == 0
    rows = mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["size"] == len(WORD.findall(ODD[r.doc_id] or "")) for r in rows if r.doc_id is not None and r.doc_id < len(ODD))


# -- op2 -------------------------------------------------------------------------------------


def test_vamana_recall_and_edges(spark):
    from attesta.llm.vamana import nearest

    rng = np.random.default_rng(3)
    v = rng.standard_normal((1500, 12)).astype(np.float32)
    v[700:760] = v[3]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows += [(5000, None, 0), (5100, [0.0] * 12, 0), (5200, [float("nan")] + [1.0] * 11, 0), (5300, [None] + [1.0] * 11, 0), (5400, [1.0, 2.0], 0), (100, v[100].tolist(), 9), (None, v[1].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in nearest(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=10, shard_points=400).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 100))
    d = v.astype(float)
    hits = 0
    for q, found in got.items():
        far = np.sqrt(((d - d[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(len(d)), far)) if i != q][:10]
        hits += len(set(want) & {i for i, _ in found})
        assert len(found) == 10 and q not in {i for i, _ in found}
        assert [s for _, s in found] == pytest.approx([far[i] for i, _ in found])
        assert found == sorted(found, key=lambda x: (x[1], x[0]))
    assert hits / (10 * len(got)) >= 0.9
    assert nearest(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("size", [1e-25, 1e20, 1e200, 1e-200])
def test_vamana_sizes(spark, size):
    """Vectors of any finite size, and one of another, over several shards."""
    from attesta.llm.vamana import nearest

    v = np.random.default_rng(6).standard_normal((600, 8)) * size
    v[17] *= 1e-30
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    hits = 0
    for r in nearest(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=5, shard_points=200).collect():
        far = np.sqrt((((v - v[r.query_id]) / size) ** 2).sum(1)) * size
        far[r.query_id] = np.inf
        assert r.score == pytest.approx(far[r.vec_id], rel=1e-9)
        hits += r.vec_id in np.argsort(far, kind="stable")[:5]
    assert hits >= 0.95 * 30


def test_vamana_few_candidates(spark):
    from attesta.llm.vamana import nearest

    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    rows = nearest(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in rows] == [(0, 1, 2), (0, 2, 1)]


# -- op3 -------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    from attesta.llm.warc import archive_and_read

    html = ["<p>hi</p>", "x" * 50000, None, "", "é" * 300, "<p>hi</p>", "x" * 50000, "<p>hi</p>"]
    pages = spark.createDataFrame([(i, f"http://h/{i}" if i % 2 else None, h, "e") for i, h in enumerate(html)] + [(0, None, "<p>hi</p>", "e")], "page_id long, url string, html string, error string")
    rows = archive_and_read(pages, segment_bytes=1000, chunk_bytes=300, file_bytes=20000).collect()
    assert len(rows) == len(html) + 1
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i)
    for r in rows:
        data = (html[r.page_id] or "").encode()
        assert r.error is None and r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if r.record_type == "response":
            assert r.page_id == first[html[r.page_id] or ""] and bytes(r.payload) == data and r.refers_to is None
        else:
            assert r.refers_to == first[html[r.page_id] or ""]
    assert sum(r.record_type == "response" for r in rows) == len(first)
    assert archive_and_read(pages.limit(0)).count() == 0


def test_warc_repeated_rows_and_small_payloads(spark):
    from attesta.llm import salting, warc

    big, rows = "y" * 30000, []
    rows += [(1, "http://a", big), (1, "http://a", big), (1, "http://a", big), (2, "http://a", big), (None, None, big), (3, "http://b", "small"), (3, "http://b", "small"), (4, "http://c", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.archive_and_read(pages, min_revisit_bytes=100, segment_bytes=1000).collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    assert sorted((r.page_id is None, r.page_id, r.record_type) for r in got if r.payload_bytes == 30000) == sorted(
        [(False, 1, "response"), (False, 1, "revisit"), (False, 1, "revisit"), (False, 2, "revisit"), (True, None, "revisit")], key=lambda x: (x[0], x[1] or 0, x[2])
    )
    assert all(r.refers_to == 1 for r in got if r.record_type == "revisit")
    assert sum(r.record_type == "response" for r in got if r.payload_bytes < 100) == 3
    # A payload that very many pages share, and files that no manifest names.
    many = spark.range(salting.KEY_ROWS * 2 + 5).selectExpr("id as page_id", "concat('http://h/', id) as url", "if(id % 3 = 0, concat('own', id), 'same') as html")
    folder = warc.scratch.new_path(spark, "w")
    warc.write(many, folder)
    files = warc.pyarrow.fs.FileSystem.from_uri(folder)
    with files[0].open_output_stream(f"{files[1]}/pages-999999-0-0000.warc.gz") as out:
        out.write(b"not a record")
    back = warc.read(spark, folder)
    assert back.count() == many.count() and back.where("error is not null").count() == 0
    assert back.where("record_type = 'response'").count() == many.select("html").distinct().count()
    assert {r.refers_to for r in back.where("record_type = 'revisit'").collect()} == {1}


def test_warc_damage_is_reported():
    from attesta.llm import warc

    whole = list(warc.records_of(1, "u", b"z" * 5000, None, None, "first", "x", 1000, 300, "2000-01-01T00:00:00Z"))
    files = [b"".join(whole), b"".join(whole[:-1])]
    for content, ok in zip(files, (True, False)):
        records = warc._records(True, lambda _, content=content: io.BytesIO(content))
        rows = [r for b in records(iter([pa.RecordBatch.from_pydict({"file": ["f"]})])) for r in b.to_pylist()]
        batch = pa.RecordBatch.from_pylist(sorted(rows, key=lambda r: (r["record_id"], r["segment"])), schema=pa.schema([(n, t) for n, t in zip(rows[0], (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()))]))
        out = [r for b in warc._decoded(warc._reassembled(iter([batch]))) for r in b.to_pylist()]
        assert len(out) == 1 and (out[0]["error"] is None) == ok


# -- op4 -------------------------------------------------------------------------------------


def test_token_files(spark):
    from tokenizers import Tokenizer

    from attesta.llm import scratch, token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ODD + ["<|endoftext|> x", "a  <|endoftext|>b c", "a  b\n\nc \n d", "it's 12 'quoted'\ttabs\xa0x"]
    docs = table(spark, texts).withColumn("file", F.lit(1)).withColumn("part", F.lit("p")).repartition(3)
    for plain in (False, True):
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = plain
        folder = scratch.new_path(spark, "t")
        index = token_files.starts(token_files.write(docs, folder, path, 2, partitions=4, plain_specials=plain))
        whole = token_files.read(index, folder).select("doc_id", "ids").orderBy("doc_id").collect()
        packed = token_files.read(index, folder, packed=True)
        got = packed.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")).orderBy("doc_id").collect()
        at = 0
        for r, w, t in zip(got, whole, texts):
            ids = library.encode(t or "", add_special_tokens=False).ids + [2]
            assert w.ids == ids
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
    empty = scratch.new_path(spark, "t")
    assert token_files.write(docs.limit(0), empty, path, 2).count() == 0


def test_token_files_repeated_rows_and_wide_ids(spark):
    from attesta.llm import scratch, token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = odd(spark).unionByName(table(spark, ["another text", "a third one"], 7).withColumn("doc_id", F.lit(7).cast("long")))
    folder = scratch.new_path(spark, "t")
    index = token_files.starts(token_files.write(docs.repartition(5), folder, path, 70000, partitions=3))
    rows = token_files.read(index, folder).orderBy("start").collect()
    assert len(rows) == docs.count() and {r.id_bytes for r in rows} == {4} and all(r.ids[-1] == 70000 for r in rows)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += len(r.ids)
    with pytest.raises(ValueError, match="fit"):
        token_files.write(docs, folder + "-2", path, 70000, id_bytes=2)


def test_frames_detect_damage(tmp_path):
    from attesta.llm.token_files import frame, unframe

    data = frame(b"abc") + frame(b"defg")
    f = tmp_path / "f"
    f.write_bytes(data)
    with f.open("rb") as h:
        assert unframe(h, 12, 3) == b"abc" and unframe(h, 12 + 3 + 16, 4) == b"defg"
    f.write_bytes(data[:13] + b"X" + data[14:])
    with f.open("rb") as h, pytest.raises(ValueError, match="damaged"):
        unframe(h, 12, 3)


# -- op5 -------------------------------------------------------------------------------------


def test_kneser_ney_against_brute_force(spark):
    from attesta.llm import kneser_ney as kn

    rng = random.Random(5)
    texts = ["".join(rng.choice("abc d") for _ in range(rng.randint(0, 80))) for _ in range(120)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0) for i in range(120)], "doc_id long, quality int")
    out = {r.doc_id: r for r in kn.classify(docs, labels).select("doc_id", "lang", "perplexity", "kept").collect()}
    assert len(out) == 120
    held = kn.mix(np.arange(120).astype(np.uint64) + np.uint64(5)) % np.uint64(kn.HELD_OUT_IN) == 0
    for lang in ("en", "de", None):
        train = [texts[i] for i in range(100) if ("en", "de", None)[i % 3] == lang and not held[i]]
        counts = {kn.ORDER: collections.Counter(("\0" * (kn.ORDER - 1) + t)[i : i + kn.ORDER] for t in train for i in range(len(t)))}
        for o in range(kn.ORDER - 1, 0, -1):
            counts[o] = collections.Counter(g[1:] for g in counts[o + 1])
        discount = {}
        for o, c in counts.items():
            n = collections.Counter(c.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
            discount[o] = [max(0.05, min(k - 0.05, 0.5 if y is None or not n[k] else k - (k + 1) * y * n[k + 1] / n[k])) for k in (1, 2, 3)]

        def p(g, counts=counts, discount=discount):
            if not g:
                return 1 / 256
            c, o = counts[len(g)], len(g)
            followers = [v for k, v in c.items() if k[:-1] == g[:-1]]
            if not followers:
                return p(g[1:])
            d = lambda v: discount[o][min(v, 3) - 1]
            total = sum(followers)
            return (max(c[g] - d(c[g]), 0) if c[g] else 0) / total + sum(map(d, followers)) / total * p(g[1:])

        for i in list(range(0, 120, 17)):
            if ("en", "de", None)[i % 3] == lang and texts[i]:
                padded = "\0" * (kn.ORDER - 1) + texts[i]
                want = np.exp(-np.mean([np.log(p(padded[k : k + kn.ORDER])) for k in range(len(texts[i]))]))
                assert out[i].perplexity == pytest.approx(want, rel=1e-9)


def test_model_larger_than_the_cache(spark, monkeypatch):
    """Shards that don't fit a worker's cache, and a memo of few slots, give the same perplexities."""
    from attesta.llm import kneser_ney as kn

    docs = table(spark, random_texts(120, 3))
    labels = spark.createDataFrame([(i, 1) for i in range(120)], "doc_id long, quality int")
    monkeypatch.setattr(kn, "SHARD_ROWS", 50)
    path, shards, _ = kn.train(docs, labels)
    assert shards > 20
    rows = docs.select("doc_id", "text").collect()
    batch = pa.RecordBatch.from_pydict({"doc_id": [r.doc_id for r in rows], "text": [r.text for r in rows]})
    whole, small = kn.Model(path, shards), kn.Model(path, shards)
    small.MOST_ROWS = 60
    lang = spark.range(1).select(F.substring(F.md5(F.lit("en")), 1, 16)).first()[0]
    keys = [kn.grams(b) for b in kn.blocks(batch.column(1), 500)]
    a, b = list(whole.scores(lang, keys)), list(small.scores(lang, keys))
    assert all((x == y).all() for x, y in zip(a, b))
    assert sum(len(k) for k, _ in small.held.values()) <= 60 < sum(len(k) for k, _ in whole.held.values())
    assert all((x == y).all() for x, y in zip(a, small.scores(lang, keys)))


def test_classifier_odd_rows(spark):
    from attesta.llm.kneser_ney import classify

    docs = odd(spark)
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.perplexity is None and not r.kept for r in rows if not r.text)
    assert classify(docs.limit(0), labels).count() == 0
    assert all(r.kept == bool(r.text) for r in classify(docs, labels.limit(0)).collect())


# -- op6 -------------------------------------------------------------------------------------


def test_byte_bpe_equals_tiktoken(spark):
    import tiktoken

    from attesta.llm.byte_bpe import PrefixTable, decode_documents, encode_documents, encoder

    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    e = encoder(*args)
    library = tiktoken.Encoding("own", pat_str=args[1], mergeable_ranks=e.vocabulary.ranks, special_tokens={})
    rng = random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "é", "日本", "🎉", "'s", "'", "1", "23", "#", "\xa0", "\x1c", " ", "A", "the", "ing", "\r\n", ".", "\x00", "ß"]
    for _ in range(1500):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        assert e.encode(s) == library.encode_ordinary(s)
    for _ in range(60):
        data = bytes(rng.choice(b"abcthe in") for _ in range(rng.randint(0, 200)))
        t = PrefixTable(e.vocabulary, data[:60])
        t.append(data[60:])
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        t.replace(a, b, b"xy")
        whole = PrefixTable(e.vocabulary, data[:a] + b"xy" + data[b:])
        assert t.last == whole.last and t.ids() == whole.ids()
    docs = odd(spark).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(1))
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    rows = decode_documents(encode_documents(docs, *args), *args).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert r.ids == library.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded).decode() == texts[r.doc_id]
    assert decode_documents(encode_documents(docs.limit(0), *args), *args).count() == 0


def test_memo_forgets():
    from attesta.llm.memo import Memo

    def as_bytes(chunks):
        data = [c.encode() for c in chunks.to_pylist()]
        return np.frombuffer(b"".join(data), np.uint8).astype(np.uint32), np.array([len(d) for d in data], np.int64)

    texts = ["a b c d e f g h", "longword b", "", " ", "\n", "a\nb", "x  y", "é ü", None, "end. of, it!", "\n.", "a\n"]
    m = Memo(as_bytes, entries=5, longest=3)
    for some in [texts[i : i + n] for n in (1, 3, 12) for i in range(len(texts))] * 2:
        ids, bounds = m.texts(pa.array(some, pa.string()))
        assert [bytes(ids[a:b].astype(np.uint8)).decode() for a, b in zip(bounds, bounds[1:])] == [t or "" for t in some]
        assert len(m.keys) <= 5 and all(len(k) <= 3 for k in m.keys.to_pylist())


def test_memo_is_for_one_pattern():
    from attesta.llm.byte_bpe import encoder

    e = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), r"[^a]+|a")
    assert e.memo is None
    assert b"".join(e.vocabulary.bytes_of[i] for i in e.encode("the \tcat, a b")) == b"the \tcat, a b"


# -- op7 -------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    from attesta.llm.chat_format import END, TURN, format_conversations, read_back

    texts = [None, "", "hi", f"a{END}\n{TURN}=user\nb", "&lt; & <", f"{TURN}", "&amp;", "</s>[INST] ok [/INST]", "x" * 5000, "é日本🎉\n", "\\"]
    rows = [(i % 3 if i != 4 else None, i, ("user", "assistant", "sys\ntem", None, "<|end|>")[i % 5], t, "x") for i, t in enumerate(texts)] + [(1, 1, "assistant", "", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    key = lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    out = {r.conv_id: r for r in read_back(format_conversations(df)).collect()}
    assert set(out) == {0, 1, 2, None}
    for conv, r in out.items():
        mine = sorted((x for x in rows if x[0] == conv), key=key)
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine] and all(t.well_formed for t in r.turns)
        assert r.loss_text == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        for x, s in zip(mine, r.loss_spans):
            piece = r.formatted[s.start : s.end]
            assert (piece.replace("&lt;", "<").replace("&amp;", "&") if s.escaped else piece) == (x[3] or "")
            assert s.trained == (x[2] == "assistant")
    assert format_conversations(df.limit(0)).count() == 0
    # The loss text is what the spans say, not what was parsed.
    off = format_conversations(df.where("conv_id = 1")).withColumn("loss_spans", F.transform("loss_spans", lambda s: s.withField("end", s["start"] + 1)))
    only = read_back(off).collect()[0]
    assert only.loss_text == "".join(only.formatted[s.start] for s in only.loss_spans if s.trained)


# -- op8 -------------------------------------------------------------------------------------


def brute_measures(t):
    t = t or ""
    w = WORD.findall(t)
    grams = list(zip(w, w[1:], w[2:]))
    n = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(covered)


def test_word_hashes_tell_apart_what_polynomials_do_not():
    from attesta.llm.wordhash import Block, hasher

    thue = "a"
    while len(thue) < 2048:
        thue += thue.translate(str.maketrans("ab", "ba"))
    words = [thue[:1024], thue[:1024].translate(str.maketrans("ab", "ba")), "a", "b", "ab", "abcdefgh", "abcdefgh" * 2, "abcdefghi", "", "x" * 5000, "x" * 5001]
    data = np.frombuffer("".join(words).encode() * 2, np.uint8)
    ends = np.cumsum([len(w) for w in words] * 2)
    h = hasher(Block(0, data, np.array([0, len(data)])))(ends - [len(w) for w in words] * 2, ends)
    assert (h[: len(words)] == h[len(words) :]).all() and len(set(h.tolist())) == len(words)


def test_quality_rules_measures(spark):
    from attesta.llm.quality_rules import ablations, apply_policy, measure, with_ledger

    rng = random.Random(3)
    alphabet = ["a", "b", " ", "\n", "é", "日", " a b c", "#", "\r", "\t", ""]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["good words " * 2 + " ".join(f"w{i}" for i in range(80))]
    docs = table(spark, texts)
    ledger = with_ledger(measure(docs)).cache()
    for r in ledger.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(texts[r.doc_id])
        assert bool(r.failed_rules & 1) == (r.n_words < 50)
    full = apply_policy(ledger, "full-1")
    assert full.where("kept").count() == full.where("failed_rules = 0").count() >= 1
    base = apply_policy(ledger, "base-1").where("kept").count()
    few = {r.rule: r for r in ablations(ledger, "base-1").collect()}["few_words"]
    assert few.n_failed == ledger.where("failed_rules & 1 <> 0").count()
    assert few.n_kept_without == base + few.n_failed_alone
    assert set(measure(docs, keep_text=True).columns) >= {"text", "doc_id"}
    assert with_ledger(measure(docs.limit(0))).count() == 0


# -- op9 -------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    from attesta.llm.toxicity import score, train, toxicity

    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts, toxic = [], []
    for _ in range(1200):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(10, 80))]
        bad = rng.random() < 0.2
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Vilest", "vilesome", "rotten!"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, t, 0) for i, t in enumerate(toxic) if i < 800], "doc_id long, toxic int, never int")
    chain = train(docs, labels, ["never", "toxic"])
    got = {r.doc_id: r for r in score(docs, chain, ["never", "toxic"]).collect()}
    held = range(800, 1200)
    assert sum(got[i].is_toxic == bool(toxic[i]) for i in held) / 400 >= 0.97
    assert not any(r.is_never for r in got.values())
    assert toxicity(docs.limit(0), labels, ["toxic"]).count() == 0
    assert toxicity(odd(spark), labels.limit(0), ["toxic"]).count() == odd(spark).count()


def test_toxicity_against_brute_force(spark):
    """The chain's probabilities from a plain loop over words, and its out-of-fold inputs."""
    from attesta.llm import toxicity as tx
    from attesta.llm.wordhash import Block, hasher

    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdEfg") for _ in range(rng.randint(2, 9))) for _ in range(120)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40))) for _ in range(400)]
    labels = [(i, int("a" in t.split()[0].lower()), int(len(t) % 3 == 0 or vocabulary[0] in t.split())) for i, t in enumerate(texts)]
    docs = table(spark, texts + [None, "", "a-b 12 é"])
    docs = docs.unionByName(docs.where("doc_id = 1").withColumn("text", F.lit("quite another text")))
    marks = spark.createDataFrame(labels, "doc_id long, one int, two int")
    chain = tx.train(docs, marks, ["one", "two"])
    assert str(tx.train(docs.repartition(7), marks, ["one", "two"])) == str(chain)

    def place(word, k):
        data = np.frombuffer(word, np.uint8)
        return int((hasher(Block(0, data, np.array([0, len(data)])), lower=True)(np.array([0]), np.array([len(data)]))[0] + np.uint64(k)) % np.uint64(tx.PLACES))

    for r in tx.score(docs, chain, ["one", "two"]).collect():
        if r.doc_id == 1:
            continue
        text = (texts + [None, "", "a-b 12 é"])[r.doc_id] or ""
        places = set()
        for w in re.findall(rb"[A-Za-z\x80-\xff]+", text.encode()):
            places |= {place(w, 0), *(place(w[:k], k) for k in tx.PREFIXES)}
        got = []
        for m in chain["models"]:
            weights = dict(zip(m["places"].tolist(), m["weights"].tolist()))
            z = sum(weights.get(p, 0.0) for p in places) + m["dense"][0] + sum(a * b for a, b in zip(got, m["dense"][1:]))
            got.append(1 / (1 + np.exp(-z)))
        assert (r.p_one, r.p_two) == pytest.approx(tuple(got)) and r.is_two == (got[1] > chain["models"][1]["threshold"])


def test_toxicity_weights_minimise_the_penalised_loss():
    """Against plain subgradient conditions on a small dense problem."""
    from attesta.llm import toxicity as tx

    rng = np.random.default_rng(1)
    x = rng.random((300, 12)) < 0.4
    y = (x[:, 0] & ~x[:, 3]).astype(float)
    flat, bounds = np.flatnonzero(x.ravel()) % 12, np.concatenate([[0], np.cumsum(x.sum(1))])
    rows = tx.Rows(flat, bounds, least=1)
    dense = np.ones((300, 1))
    w, b = tx._descend(rows, dense, y, np.ones(300, bool), 0.02, 4000)
    scaled = x[:, rows.places] * rows.scale
    gradient = scaled.T @ (tx._sigmoid(scaled @ w + b[0]) - y) / 300
    assert np.abs(gradient[w == 0]).max(initial=0) <= 0.02 + 1e-4
    assert np.allclose(gradient[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-4)


# -- op10 ------------------------------------------------------------------------------------


def brute_components(ids, texts, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)), key=lambda k: ids[k])
                parent[q] = p
    return {ids[i]: (len(sets[i]), ids[find(i)]) for i in range(len(ids))}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_brute_force(spark, percent):
    from attesta.llm.near_duplicates import near_duplicates

    texts = random_texts(250, percent) + [t for t in ODD]
    rows = near_duplicates(table(spark, texts), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(list(range(len(texts))), texts, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_blocks_and_odd_rows(spark):
    from attesta.llm.near_duplicates import near_duplicates

    texts = random_texts(150, 9)
    docs = table(spark, texts)
    assert sorted(near_duplicates(docs, 85, block=3).collect()) == sorted(near_duplicates(docs, 85).collect())
    rows = near_duplicates(odd(spark), 85).collect()
    assert len(rows) == odd(spark).count()
    assert [r.component_id for r in rows if r.doc_id == 12] == [11] and [r.kept for r in rows if r.doc_id == 4] == [True, True]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_links_connect_what_all_links_connect():
    from attesta.llm.near_duplicates import POSITIONS, links_of_open

    rng = random.Random(4)
    for _ in range(60):
        sets = [sorted(rng.sample(range(30), rng.randint(1, 12))) for _ in range(rng.randint(2, 20))]
        sets += [sorted({*s[1:], 99}) for s in sets if len(s) > 6]
        names = [b"%03d" % i for i in range(len(sets))]
        rows = [
            {"g": b"none", "cls": n, "is_open": o, "near": False, "linked": False, "sig": bytes(2 * POSITIONS), "shingles": np.array(s, np.uint64).tobytes()} for o in (False, True) for n, s in zip(names, sets)
        ]
        parent = {n: n for n in names}
        find = lambda i: i if parent[i] == i else find(parent[i])
        for i, j in links_of_open(pa.Table.from_pylist(rows), 60, POSITIONS):
            parent[find(i)] = find(j)
        other = list(range(len(sets)))
        root = lambda i: i if other[i] == i else root(other[i])
        for i in range(len(sets)):
            for j in range(i):
                if 100 * len({*sets[i]} & {*sets[j]}) >= 60 * len({*sets[i]} | {*sets[j]}):
                    other[root(i)] = root(j)
        assert all((find(names[i]) == find(names[j])) == (root(i) == root(j)) for i in range(len(sets)) for j in range(i))


def test_near_duplicates_large_group_of_long_texts(spark):
    """Thousands of long near copies, some apart, and thousands of exact ones: more than one salt and block."""
    from attesta.llm import salting
    from attesta.llm.near_duplicates import near_duplicates

    rng = random.Random(12)
    base = ["w%d" % rng.randrange(10**6) for _ in range(400)]
    n = salting.KEY_ROWS + 300
    texts = []
    for i in range(n):
        words = list(base)
        for _ in range(1 if i % 7 else 9):
            words[rng.randrange(400)] = "e%d" % rng.randrange(10**6)
        texts.append(" ".join(words))
    texts += ["the same five words here again"] * n
    rows = {r.doc_id: r for r in near_duplicates(table(spark, texts), 85, block=500, block_bytes=1 << 20).collect()}
    assert len(rows) == len(texts)
    assert {rows[i].component_id for i in range(n, 2 * n)} == {n}
    sets = [{hash(tuple(t.split()[k : k + 5])) for k in range(396)} for t in texts[:n]]
    common = [i for i in range(n) if i % 7]
    assert {rows[i].component_id for i in common} == {rows[common[0]].component_id}
    for i in range(0, n, 7 * 41):  # far ones: linked just if they are near enough to any other
        linked = any(j != i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for j in range(n))
        assert (rows[i].component_id == rows[common[0]].component_id) == linked


# -- pipeline --------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(8)
    words = ["".join(rng.choice("abcde ") for _ in range(6)).strip() or "a" for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(55, 90))) for _ in range(200)]
    texts += texts[:20] + ["!!## " * 80, "SHOUT " * 90]
    docs = table(spark, texts).select("doc_id", "text", F.lit("en").alias("lang"), "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    assert {220, 221}.isdisjoint(kept[1]) and kept[1] <= kept[0]
    assert kept[2] == kept[1] - {i for i in range(200, 220) if i in kept[1] and i - 200 in kept[1]}
    last = cp.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert len(last) == now.count() and all(r.n_tokens == len(r.ids) > 0 for r in last)
    assert sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.n_tokens) for r in last)


def test_pipeline_keeps_one_row_of_each_group(spark):
    from corpus_pipeline import near_duplicate_removal

    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in ("one", "two", "three"))
    rows = [(1, a), (1, a), (None, a), (7, b), (7, c), (2, b), (None, c), (None, "alone " + c[::-1]), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_duplicate_removal(spark, docs, "").collect() if r.doc_id is not None)
    kept = near_duplicate_removal(spark, docs, "").collect()
    assert got == sorted([(1, a), (2, b), (7, c), (9, "")])
    assert [r.text for r in kept if r.doc_id is None] == ["alone " + c[::-1]]
