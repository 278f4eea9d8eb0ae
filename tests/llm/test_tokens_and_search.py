"""Packing, SentencePiece, token counts and nearest neighbours against plain versions; the pipeline as a whole."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestar.llm import ann, packing, quality, secrets, sentencepiece, simhash, tokencounts, toxicity
from lodestar.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD, BYTE, PIECE = (public_tokenizers.path(p) for p in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "\n\n x\n \n", "tok▁en x", "日本語 テキスト　full", "a" * 500 + " " + "xyz" * 100, "é́ ﬁ \x1c! \x85 z", "I'll <|endoftext|> 123 4567  \t x", "q \xa0 w.", "Ünïcode, ÀB. ...", "don't. we'd, x.y", "<|ENDOFTEXT|> hello", "<|StartOfText|>. a<|endoftext|>B <|startoftext|>x, Y<|", "É<|endoftext|>\u0301 <|EndOfText|>.", "ΑΣ ΣΑΣ. İx K"]


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()] + ODD


def frame(spark, texts):
    return spark.createDataFrame([*enumerate(texts), (None, "no id"), (10_000, None), (3, texts[3])], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))


def test_word_ids_are_the_tokenizers(texts):
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(WORD), packing.WordIds(WORD)
    for _ in range(2):  # the second time from the cache
        for x in texts:
            assert own(x.encode(), 2).tolist() == t.encode(x, add_special_tokens=False).ids + [2]
    words = sorted({w for x in texts for w in x.lower().split() if packing.is_plain(w)})
    assert own.merge is not None and [own.merge(w) for w in words] == [e.ids for e in t.encode_batch(words, add_special_tokens=False)]


def test_word_ids_of_made_up_strings():
    """20,000 strings of capitals, special strings in any case, composed and decomposed letters."""
    import random

    from tokenizers import Tokenizer

    t, own, rnd = Tokenizer.from_file(WORD), packing.WordIds(WORD), random.Random(1)
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>", "Hello", "WORLD", "é", "É", "\u0301", "a", "B", "Ω", "Σ", "ß", "İ", "\u212a", " ", "  ", "\n", "\t", ".", ",", "'s", "'S", "123", "!", "<|", "|>", "日本", "ﬁ", "The", "don't", "\xa0", "\x1c", "ing", "ed"]
    made = ["".join(rnd.choices(bits, k=rnd.randint(1, 12))) for _ in range(20_000)]
    for x, e in zip(made, t.encode_batch(made, add_special_tokens=False)):
        assert own(x.encode(), 2).tolist() == e.ids + [2], x


def test_windows_place_best_fit():
    """Against a plain search over the open windows: the fullest that fits, and the fullest goes when none does."""
    import random

    rnd, space, open_ = random.Random(2), packing.Windows(100, 4), []
    for _ in range(3000):
        size = rnd.randint(1, 99)
        w, gone = space.place(size)
        fits = [x for x in open_ if 100 - x["used"] >= size]
        if fits:
            want = max(fits, key=lambda x: x["used"])
            assert gone is None and w[0] == want["used"]
        else:
            if len(open_) == 4:
                full = max(open_, key=lambda x: x["used"])
                assert gone[0] == full["used"]
                open_.remove(next(x for x in open_ if x["number"] == gone[1]))
            open_.append(want := {"used": 0, "number": w[1]})
        mine = next(x for x in open_ if x["number"] == w[1])
        done = space.put(w, size, ("d",))
        mine["used"] += size
        assert (done is not None) == (mine["used"] == 100)
        if done is not None:
            open_.remove(mine)
        assert sorted(x["used"] for x in open_) == sorted(x[0] for x in space.open) and len(open_) <= 4


@pytest.mark.parametrize("length,windows", [(4096, 32), (64, 3)])
def test_packing_is_exact(spark, texts, length, windows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    docs = frame(spark, texts).repartition(3)
    rows = packing.pack(docs, WORD, length=length, windows=windows).collect()
    of, seqs = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.length > 0
        of.setdefault(r.doc_id, []).append((r.start, ids.tolist(), r.doc_tokens))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():  # gapless from 0, and never too long
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    want = {}
    for r in docs.select("doc_id", "text").collect():
        want.setdefault(r.doc_id, []).append(t.encode(r.text or "", add_special_tokens=False).ids + [2])
    for doc, whole in want.items():
        got = sorted(of[doc])
        if len(whole) == 1:
            assert [x for _, ids, _ in got for x in ids] == whole[0] and all(n == len(whole[0]) for _, _, n in got)
        else:
            assert sum(len(ids) for _, ids, _ in got) == sum(map(len, whole))
    assert packing.pack(docs.limit(0), WORD).count() == 0


def test_packing_pads_little(spark):
    rows = Q.op4_open_window_packing(spark, "/root/testdata/sf0.01").groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in rows) / (4096 * len(rows)) >= 0.95


def test_pieces_are_the_librarys(spark, texts):
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=PIECE)
    rows = sentencepiece.encode(frame(spark, texts), PIECE).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        text = "no id" if r.doc_id is None else "" if r.doc_id == 10_000 else texts[r.doc_id]
        assert r.ids == sp.encode(text) and r.n_ids == len(r.ids) and r.round_trip == ("▁" not in text)
    back = {r.doc_id: r.text for r in sentencepiece.decode(sentencepiece.encode(frame(spark, texts), PIECE), PIECE).collect()}
    assert all(back[i] == sp.decode(sp.encode(t)) for i, t in enumerate(texts))


def test_viterbi_is_best():
    """Against all segmentations of short words, for a unigram model of a few pieces."""
    names = ["a", "b", "ab", "ba", "aba", "bb", "▁"]
    scores = [-2.0, -2.5, -3.0, -3.9, -4.2, -4.0, -1.0]
    p = sentencepiece.Pieces(names, scores, {}, unknown=99)

    def best(w):
        if not w:
            return 0.0
        return max((scores[names.index(w[:k])] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in names), default=-np.inf)

    words = ["a", "abab", "bbab", "ababab", "baba", "aab", "bbbb"]
    for w, raw in zip(words, sentencepiece.encode_words(p, words, "viterbi")):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert "".join(names[i] for i in ids) == w and sum(scores[i] for i in ids) == pytest.approx(best(w))


def test_viterbi_of_whole_documents(spark, texts):
    """The public pieces and scores as a unigram model: totals equal a plain dynamic programme's, word by word."""
    p = sentencepiece.Pieces.load(PIECE)
    codec, low = sentencepiece.Codec(p, "viterbi"), float(p.scores.min()) - 10

    def best(w):
        score = [0.0] + [-np.inf] * len(w)
        for end in range(1, len(w) + 1):
            for a in range(max(0, end - p.longest), end):
                s = p.score_of.get(w[a:end], low if end - a == 1 else None)
                if s is not None:
                    score[end] = max(score[end], score[a] + s)
        return score[-1]

    checked = 0
    for t in texts[:12] + ODD:
        ids = codec.encode(t.encode())
        if "▁" not in t:
            assert codec.decode(ids) == t.encode()
        for w in set(sentencepiece._WORD.findall(b" " + t.encode()) if t else []):
            word = w.decode().replace(" ", "▁")
            if len(word) > 60:
                continue
            got = np.frombuffer(codec.known[w], "<u4").tolist()
            if any(i in p.byte_ids.values() for i in got):
                continue  # a character that no piece holds stands as its bytes
            assert sum(p.score_of[p.text[i]] for i in got) == pytest.approx(best(word))
            checked += 1
    assert checked > 500


def test_tokens_of_empty_tables(spark):
    none = frame(spark, ODD).limit(0)
    assert sentencepiece.encode(none, PIECE).count() == tokencounts.count_by_section(none, BYTE).count() == packing.pack(none, WORD).count() == 0
    assert sentencepiece.decode(sentencepiece.encode(none, PIECE), PIECE).count() == 0


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_section_counts(spark, texts, rule):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    rows = tokencounts.count_by_section(frame(spark, texts), BYTE, rule).where("doc_id is not null and doc_id <> 3").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, x in enumerate(texts):
        if i == 3:
            continue
        got = sorted(by[i], key=lambda r: r.section)
        spans = t.encode(x, add_special_tokens=False).offsets
        want = [0] * len(got)
        for a, b in spans:
            hits = [k for k, r in enumerate(got) if a < r.end and max(b, a + 1) > r.start] or [0]
            held = [min(b, got[k].end) - max(a, got[k].start) for k in hits]
            want[{"start": hits[0], "end": hits[-1], "most": hits[int(np.argmax(held))]}[rule]] += 1
        assert [r.tokens for r in got] == want and sum(want) == len(spans)
        assert got[0].start == 0 and got[-1].end == len(x) and all(p.end == q.start for p, q in zip(got, got[1:]))
    assert by[10_000][0].tokens == 0


def test_neighbours_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in Q.op1_permutation_index(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        mine = sorted(got[ids[q]])
        assert [m[0] for m in mine] == list(range(1, 21)) and mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        hits += len(set(want) & {m[1] for m in mine})
        total += 20
    assert hits / total >= 0.9


@pytest.mark.parametrize("kind", ["unit", "lengths 0.3", "lengths 0.6", "common direction", "clusters"])
def test_neighbours_recall_whatever_the_shape(spark, kind):
    r = np.random.default_rng(6)
    x = r.normal(size=(12_000, 64))
    if kind == "common direction":
        x[:, 0] += 10
    elif kind == "clusters":
        x = r.normal(size=(30, 64))[r.integers(0, 30, 12_000)] * 2 + x
    else:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind.startswith("lengths"):
        x *= r.lognormal(0, float(kind.split()[1]), size=(len(x), 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for g in ann.search(df, F.expr("id % 60 = 0")).collect():
        got.setdefault(g.query_id, set()).add(g.vec_id)
    s = x[::60] @ x.T
    s[np.arange(200), np.arange(0, 12_000, 60)] = -np.inf
    hits = sum(len(got[60 * q] & set(np.argsort(-s[q])[:20].tolist())) for q in range(200))
    assert len(got) == 200 and hits >= 0.9 * 200 * 20


def test_neighbours_of_several_lengths(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)] + [(5 + i, [1.0, float(i), 2.0]) for i in range(4)] + [(9, [1.0])]
    got = [(g.query_id, g.vec_id) for g in ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.expr("id in (1, 6, 9)"), k=2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 4), (1, 3), (6, 8), (6, 7)]


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (20, [0.0, 1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("id", F.lit(7))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, F.expr("id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 2, 0.5), (20, 3, 0, 0.0), (20, 4, 0, 0.0)]
    assert ann.search(df.limit(0), F.expr("id % 20 = 0")).count() == 0


def test_equal_vectors_tie(spark):
    """Equal vectors score alike wherever they stand, so ties go to the smaller id; a repeated query id asks its least vector once."""
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 17))
    x[300:340] = x[300] * 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(0, [-9.0] + x[0].tolist()[1:])], "vec_id bigint, embedding array<double>")
    got = {}
    for g in ann.search(df, F.expr("id in (0, 300)"), k=30, shard_rows=100).collect():
        got.setdefault(g.query_id, []).append((g["rank"], g.vec_id, g.score))
    first = [i for _, i, _ in sorted(got[300])]
    assert first == list(range(301, 331)) and len({s for _, _, s in got[300]}) == 1
    asked = np.array([min(-9.0, x[0][0]), *x[0][1:]])
    assert len(got[0]) == 30 and all(s == pytest.approx(float(asked @ x[i])) for _, i, s in got[0])


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, clashing names and empty tables through every stage, labels odd as well."""
    import corpus_pipeline as C

    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(None, "only one has this"), (5, "same words are here"), (5, "same words are here"), (None, "same words are here"), (6, None), (7, ""), (8, "x" * 100_000), (9, "password = abcdefgh1")]
    docs = spark.createDataFrame([(*r, "en", "s", None, 0.5, 1, 2, "b", "w") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, _score double, _row int, _fp int, base string, words string")
    for some in (docs, docs.limit(0)):
        kept = some
        for name, stage in C.STAGES[:4]:
            out = stage(spark, kept, str(tmp_path))
            assert out.columns == docs.columns, name
            kept = spark.createDataFrame(out.collect(), docs.schema)
            assert kept.count() <= some.count()
        C.STAGES[4][1](spark, kept, str(tmp_path)).collect()
    deduplicated = C.dedup_stage(spark, docs, str(tmp_path))
    assert sorted(map(repr, ((r.doc_id, (r.text or "")[:4]) for r in deduplicated.collect()))) == sorted(map(repr, [(None, "only"), (5, "same"), (6, ""), (8, "xxxx"), (9, "pass")]))
    masked = C.secrets_stage(spark, docs, str(tmp_path)).where("doc_id = 9").first()
    assert masked.text == "[SECRET]" and masked.n_chars == 8


def test_pipeline_equals_its_parts(spark):
    """Stage by stage over the smallest table, each decision made again row by row."""
    import corpus_pipeline as C

    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    cols = docs.columns
    kept = docs
    for name, stage in C.STAGES[:4]:
        out = stage(spark, kept, SF)
        assert out.columns == cols, name
        before, after = {r.doc_id: r for r in kept.collect()}, {r.doc_id: r for r in out.collect()}
        if name == "quality classifier":
            net = quality.train(quality.labelled_sample(docs, labels, "quality", 3, 1))
            assert set(after) == {i for i, r in before.items() if net.scores([r.text.encode()])[0] >= 0.5}
        elif name == "toxicity":
            pu = toxicity.train(kept, labels)
            assert set(after) == {i for i, r in before.items() if pu.score(r.text) < 0.3}
        elif name == "simhash near-dedup":
            fps = {i: simhash.simhash(r.text.encode()) for i, r in before.items()}
            low = dict(zip(fps, fps))
            for _ in fps:
                new = {i: min(low[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 2) for i in fps}
                if new == low:
                    break
                low = new
            assert set(after) == {i for i in fps if low[i] == i}
        else:
            model = secrets.train(kept)
            assert set(after) == set(before)
            for i, r in before.items():
                spans = model.spans(r.text, secrets.base_spans(r.text))
                assert (after[i].text == r.text) == (not spans) and after[i].n_chars == len(after[i].text)
        kept = spark.createDataFrame(out.collect(), docs.schema)
    packed = C.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.collect()}
