"""Text operators against brute force, on a corpus of awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from trialpulse.llm import decontaminate, jaccard, kernel, langmodel, pieces, prefixfree, quality, superkmer, tokencount

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode())


def corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(400)] + ["É", "naïve", "straße", "日本", "Ok."]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base, passage = prose(150), prose(70)
    rows = [None, "", " ", "\n\t ", "one", "two words", "two words", "ONE two Three four", base, base, base.upper()]
    for _ in range(60):  # near copies with up to six edits
        w = base.split(" ")
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append(" ".join(w))
    for _ in range(40):
        t = prose(rng.randint(1, 300))
        rows.append(t if rng.random() < 0.6 else t + "\n" + passage + " " + prose(rng.randint(0, 40)))
    rows += ["be " * 400, "be " * 390 + "end", "ab" * 500, "x" * 1000, "x" * 199, "é" * 150, prose(20000), "a  b   c   d\r\n\x0b e", "<|endoftext|> and <|endoftext|>", "▁marks ▁ here"]
    ids = list(range(3, 3 + 2 * len(rows), 2))
    rng.shuffle(ids)
    return list(zip(ids, rows))


ROWS = corpus()
ITEMS = [(1, "Alpha beta gamma"), (2, None), (3, ""), (10, ROWS[20][1]), (11, " ".join((ROWS[80][1] or "x y").split()[:12])), (9, "two, WORDS!"), (12, "one"), (13, "nothing of this kind stands in any text that is here at all ok")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1, "k", "w", 2, 3) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, shard int, key string, words string, cls int, token int").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_similar_documents_form_the_components_of_all_links(docs):
    sets = {}
    for i, t in ROWS:
        w = [x.lower() for x in words(t)]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    links = 0
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                    links += 1
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    assert links > 100
    got = by_id(jaccard.similar(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), find(i)) for i in ids}


def test_language_model_scores_and_counts(docs):
    counts = [Counter(), Counter(), Counter()]
    total, texts = 0, {}
    for i, t in ROWS:
        w = ["<s>", "<s>", *(x.lower() for x in words(t)), "</s>"]
        texts[i] = w
        if zlib.crc32(str(i).encode()) % 5 != 1:
            total += len(w) - 2
            counts[0].update(w[1:])
            counts[1].update(zip(w, w[1:]))
            counts[2].update(zip(w, w[1:], w[2:]))
    mass = total + 0.5 * (len(counts[0]) - 1 + 1)
    got = by_id(langmodel.score_documents(docs, mu2=20.0, mu3=3.0))
    for i, w in texts.items():
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) - 2, sum(counts[0][x] > 0 for x in w[2:]), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[0][x] + 0.5) / mass) for x in w[2:]), rel=1e-9)
        score = 0.0
        for a, b, c in zip(w, w[1:], w[2:]):
            p = (counts[0][c] + 0.5) / mass
            p = (counts[1][b, c] + 20 * p) / (counts[0][b] + 20)
            score += math.log10((counts[2][a, b, c] + 3 * p) / (counts[1][a, b] + 3))
        assert abs(r.score - score) <= 4e-4 * (len(w) - 2)


def test_a_stored_model_scores_texts_that_it_has_not_seen(docs, spark, tmp_path):
    learnt = [t for i, t in ROWS if i % 4]
    spark.createDataFrame([(i, t) for i, t in ROWS if i % 4], "doc_id long, text string").repartition(3).createOrReplaceTempView("learnt")
    counts, total = [Counter(), Counter(), Counter()], 0
    for t in learnt:
        w = ["<s>", "<s>", *(x.lower() for x in words(t)), "</s>"]
        total += len(w) - 2
        for n in (1, 2, 3):
            counts[n - 1].update([tuple(w[k : k + n]) for k in range(2 - (n > 1) - (n > 2), len(w) - n + 1)])
    texts = [None, "", "one", "words of no kind", "be be be be", " ".join(t.decode() for t in words(ROWS[30][1])), ROWS[12][1]]
    langmodel.build(spark.table("learnt"), str(tmp_path / "model"))
    fresh = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = by_id(langmodel.score_texts(fresh, str(tmp_path / "model"), mu2=20.0, mu3=3.0))
    mass = total + 0.5 * (len(counts[0]) + 1)
    starts = len(learnt)
    for i, t in enumerate(texts):
        w = ["<s>", "<s>", *(x.lower() for x in words(t)), "</s>"]
        want = base = 0.0
        for a, b, c in zip(w, w[1:], w[2:]):
            one = (counts[0][(c,)] + 0.5) / mass
            head = starts if b == "<s>" else counts[0][(b,)]
            two = (counts[1][(b, c)] + 20 * one) / (head + 20)
            context = starts if (a, b) == ("<s>", "<s>") else counts[1][(a, b)]
            want += math.log10((counts[2][(a, b, c)] + 3 * two) / (context + 3))
            base += math.log10(one)
        assert got[i].train_tokens == total and got[i].n_tokens == len(w) - 2 and got[i].held_out
        assert got[i].base_score == pytest.approx(base, abs=1e-6) and abs(got[i].score - want) < 2e-3 * len(w)
        assert got[i].n_known == sum(counts[0][(c,)] > 0 for c in w[2:])


def test_frequent_bigrams_are_dealt_apart_with_the_same_scores(docs, monkeypatch):
    want = by_id(langmodel.score_documents(docs))
    monkeypatch.setattr(langmodel, "HEAVY", 2)  # seen by the driver's closures only where tasks read it from there
    b = langmodel._Block(pa.table({"doc_id": [i for i, _ in ROWS], "text": [t for _, t in ROWS]}), 5, 1)
    names, counts = langmodel._word_counts(pa.table({"doc_id": [i for i, _ in ROWS], "text": [t for _, t in ROWS]}), 5, 1)
    shards = 7
    sent = langmodel._send_words(names, counts, 0, shards)
    replies = [langmodel._number(sent.filter(pa.array(sent["shard"].to_numpy() == s)), s, shards)[0] for s in range(shards)]
    w = langmodel._Words(pa.concat_tables(replies))
    g = langmodel._Grams(b, w, shards)
    assert len(g.apart) and len(g.near)
    asked = g.send(0, w.total)
    parts = [asked.filter(pa.array(asked["shard"].to_numpy() == s)) for s in range(shards)]
    answers = [(x := langmodel._Shard(p)).answer(p, langmodel.T.mapped(x.trie())) for p in parts if p.num_rows]
    got = langmodel._scores(b, w, g, pa.concat_tables(answers), 500.0, 1.0, [i for i, _ in ROWS]).to_pylist()
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]].score, rel=1e-9) and r["n_known"] == want[r["doc_id"]].n_known


def test_token_counts_are_the_librarys_and_the_cache_is_used(docs, spark, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    got = by_id(tokencount.count_tokens(docs, path, cache))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    for i, t in ROWS:
        n = len(tok.encode(t or "", add_special_tokens=False))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in ROWS})
    again = spark.createDataFrame([(1, ROWS[8][1]), (2, "never seen"), (None, "never seen")], "doc_id long, text string")
    assert {(r.doc_id, r.n_tokens) for r in tokencount.count_tokens(again, path, cache).collect()} == {(1, got[ROWS[8][0]].n_tokens), (2, 2), (None, 2)}
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in ROWS}) + 1


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination_finds_every_window(docs, spark, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    wins = defaultdict(set)
    for i, t in ITEMS:
        w = ITEM_WORD.findall((t or "").encode().lower())
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])].add(str(i))
    got = by_id(decontaminate.decontaminate(docs, items, broadcast_bytes=limit))
    hits = 0
    for i, t in ROWS:
        w = ITEM_WORD.findall((t or "").encode().lower())
        hit, names = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    names |= wins[tuple(w[k : k + n])]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(names), digest, bool(hit))
        hits += bool(hit)
    assert hits > 3


def test_byte_repeats(docs):
    counts = Counter()
    data = {i: (t or "").encode() for i, t in ROWS}
    for b in data.values():
        counts.update(b[k : k + 200] for k in range(len(b) - 199))
    got = by_id(prefixfree.remove_repeats(docs))
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if counts[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())


def test_word_windows(docs):
    text = {i: words(t) for i, t in ROWS}
    first = {}
    for i in sorted(text):
        for k in range(len(text[i]) - 49):
            first.setdefault(tuple(text[i][k : k + 50]), i)
    got = by_id(superkmer.deduplicate(docs, with_text=True, keep=["key"]))
    removed = 0
    for i, t in ROWS:
        w = text[i]
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256, r.key) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), "k")
        assert r.kept_text == (kept.decode() if any(gone) else t or "")
        removed += sum(gone)
    assert removed > 1000


def test_pieces_are_the_best_segmentation_and_decode_back(docs):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # the same pieces and scores, read as a unigram model
    unigram = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    got = by_id(pieces.encode(docs, path))
    for i, t in ROWS:
        r = got[i]
        assert r.round_trip == ("▁" not in (t or ""))
        if r.round_trip:
            assert pieces.decode(r.ids, path) == (t or "")
        assert r.n_tokens == len(r.ids)
    # the library rounds sums of scores, so words are compared, and longer texts by their sums
    score = [int(p.score) for p in model.pieces]
    some = sorted({w for _, t in ROWS[:120] for w in (t or "").split() if w.isascii() and len(w) < 20})
    mine = [list(x) for x in pieces.encode_batch(some, path)]
    theirs = unigram.encode(some)
    assert sum(a == b for a, b in zip(mine, theirs)) > 0.98 * len(some) > 300
    assert all(sum(score[i] for i in a) >= sum(score[i] for i in b) for a, b in zip(mine, theirs))


def test_quality_learns_from_positives_and_unlabelled_rows(spark):
    rng = random.Random(1)

    def text(good):
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 200))]
        return " ".join(w) if good else " ".join(x.upper() + "!!" for x in w) if rng.random() < 0.5 else (w[0] + " ") * len(w)

    kind = {i: int(rng.random() < 0.8) for i in range(1200)}
    docs = spark.createDataFrame([(i, text(k)) for i, k in kind.items()] + [(None, "x"), (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, k in kind.items() if i % 3 == 0] + [(None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(kind) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r.predicted == kind[r.doc_id] for r in got if r.held_out and r.doc_id in kind]
    assert len(held) > 200 and sum(held) / len(held) > 0.95
    kept = quality.classify(docs, labels, good_only=True)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_empty_tables(spark, empty, tmp_path):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (
        jaccard.similar(empty),
        langmodel.score_documents(empty),
        tokencount.count_tokens(empty, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "c")),
        decontaminate.decontaminate(empty, items),
        prefixfree.remove_repeats(empty),
        superkmer.deduplicate(empty),
        pieces.encode(empty, public_tokenizers.path("piece_bpe_32k.model")),
        quality.classify(empty, labels),
    ):
        assert df.count() == 0


def test_no_items(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.decontaminate(docs, none).collect()} == {0}


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(None, text), (None, text), (4, text), (4, text), (2, text), (None, None), (9, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.similar(docs).collect()) == [(0, 0), (0, 2), (0, 2), (2, 2), (4, 2), (4, 2), (9, 9)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in superkmer.deduplicate(docs).collect()) == [(0, 0), (0, 80), (0, 80), (2, 0), (4, 80), (4, 80), (9, 0)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in prefixfree.remove_repeats(docs).collect()) == [(0, 0)] + [(0, len(text))] * 2 + [(2, len(text))] + [(4, len(text))] * 2 + [(9, 0)]
    items = spark.createDataFrame([(7, text)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.n_hit) for r in decontaminate.decontaminate(docs, items).collect()) == [(0, 0), (0, 80), (0, 80), (2, 80), (4, 80), (4, 80), (9, 0)]
    assert langmodel.score_documents(docs).count() == 7
    assert tokencount.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), "/tmp/none-" + hashlib.md5(str(random.random()).encode()).hexdigest()).count() == 7


@pytest.mark.parametrize("bound", [1, 3000])
def test_word_windows_of_heavy_minimisers(docs, bound):
    assert sorted(superkmer.deduplicate(docs, bound=bound).collect()) == sorted(superkmer.deduplicate(docs, bound=1 << 60).collect())


def test_a_shared_passage_does_not_make_a_bucket_large(spark):
    rng = random.Random(3)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))

    shared = prose(30)
    rows = [(i, prose(60) + " " + shared + " " + prose(60)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    n, bound = 64, 40_000
    block = superkmer._Block(pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}), 50, 4)

    def largest(heavy):
        t = superkmer._messages(block, 0, n, heavy)
        return max(int.from_bytes(k[:8], "little") for s, k in zip(t["shard"].to_pylist(), t["keys"].to_pylist()) if s < n), sum(s >= n for s in t["shard"].to_pylist())

    heavy = superkmer._heavy(docs, "text", n, 50, 4, bound)
    (before, none), (after, dealt) = largest(np.zeros(0, np.uint64)), largest(heavy)
    mean = sum(len(t) for _, t in rows) * 4 / n
    assert none == 0 and before > 2 * (mean + bound) > 2 * after and n / 2 < dealt <= n


def test_parse_and_dictionary_give_corpus_order():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (300, 12)).astype(np.uint8)
    order, common = prefixfree.suffix_array(rows)
    plain = sorted(range(300), key=lambda i: (rows[i].tobytes(), i))
    assert order.tolist() == plain
    for a, b, n in zip(order[:-1], order[1:], common[1:]):
        assert n == next((k for k in range(12) if rows[a][k] != rows[b][k]), 12)
    # windows of phrases: the order of (bytes before the trigger, rank of the text from it on) is that of the windows themselves
    width, phrases = 12, []
    for _ in range(200):
        before = int(rng.integers(0, 5))
        windows = int(rng.integers(1, before + 2))
        phrases.append((rng.integers(97, 99, windows + width - 1).astype(np.uint8), before, windows))
    text, before, windows = np.concatenate([p for p, _, _ in phrases]), *(np.array([p[i] for p in phrases]) for i in (1, 2))
    parse = np.zeros((200, width), np.uint8)
    for i, (p, b, _) in enumerate(phrases):
        parse[i, : len(p) - b] = p[b:]
    rank = np.empty(200, np.int64)
    rank[prefixfree.suffix_array(parse)[0]] = np.arange(200)
    all_ = [(p[s : s + width].tobytes(), p[s:b].tobytes(), int(rank[i])) for i, (p, b, w) in enumerate(phrases) for s in range(w) if s <= b]
    same_split = defaultdict(list)
    for whole, head, r in all_:
        same_split[len(head)].append((whole, head, r))
    for group in same_split.values():
        assert [w for w, _, _ in sorted(group, key=lambda g: g[1:])] == sorted(w for w, _, _ in group)
    # a window occurs twice if its bytes do, with the same number of them before the trigger
    seen = Counter((b - s, p[s : s + width].tobytes()) for p, b, w in phrases for s in range(w))
    want = [seen[b - s, p[s : s + width].tobytes()] > 1 for p, b, w in phrases for s in range(w)]
    assert prefixfree.repeated(text, before, windows, width).tolist() == want and any(want) and not all(want)


@pytest.mark.parametrize("heavy", [1, 3])
def test_byte_repeats_of_crowded_contexts(docs, heavy):
    assert sorted(prefixfree.remove_repeats(docs, heavy=heavy).collect()) == sorted(prefixfree.remove_repeats(docs).collect())


def test_phrases_of_a_context_keep_their_order_where_rows_of_a_block_do_not():
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(600))
    rows = []
    for i in range(40):
        at = rng.randrange(600)
        rows.append((i, base[:at] + "#" * rng.randint(1, 3) + base[at:]))
    sent = []
    for some in (rows, rows[::-1], rng.sample(rows, 40)):
        p = prefixfree._Parse(pa.table({"text": [t for _, t in some]}), 200, 100, 16)
        distinct, count, index = p.dictionary()
        marks = np.where(count > 1, prefixfree.REPEATED | prefixfree.FIRST | prefixfree.SHARED, prefixfree.SHARED).astype(np.int8)
        calm, _ = p.chosen(marks, distinct, index)
        assert len(np.unique(p.context[calm])) < len(calm)
        sent.append(p.pack(0, calm, 4).to_pylist())
    assert sent[0] == sent[1] == sent[2]


def test_quality_risk_gradient_and_prior_agree_with_direct_computation():
    rng = np.random.default_rng(2)
    x_p, x_u = rng.normal(0.7, 1, (40, 6)), np.concatenate([rng.normal(0.7, 1, (30, 6)), rng.normal(-0.7, 1, (30, 6))])
    for w, prior in ((rng.normal(0, 0.3, 6), 0.5), (np.full(6, 3.0), 0.9)):
        up, rest = quality.risk(w, x_p, x_u, prior)
        direct = [sum(math.log(1 + math.exp(-float(a @ w))) for a in x_p) / 40 * prior, sum(math.log(1 + math.exp(float(a @ w))) for a in x_u) / 60 - prior * sum(math.log(1 + math.exp(float(a @ w))) for a in x_p) / 40]
        assert (up, rest) == (pytest.approx(direct[0]), pytest.approx(direct[1]))
        step = np.eye(6) * 1e-5
        slope = [np.subtract(quality.risk(w + s, x_p, x_u, prior), quality.risk(w - s, x_p, x_u, prior)) / 2e-5 for s in step]
        want = [a + b if rest >= 0 else -b for a, b in slope]
        assert quality.gradient(w, x_p, x_u, prior) == pytest.approx(want, abs=1e-5)
    scores_p, scores_u = np.sort(rng.normal(1, 1, 50)), rng.normal(0, 1, 80)
    cuts = np.unique(np.quantile(scores_p, np.linspace(0, 0.1, 41)))
    assert quality._ratio(scores_p, scores_u) == pytest.approx(min(((scores_u >= c).mean()) / ((scores_p >= c).mean()) for c in cuts))


def test_quality_inputs_are_shares_of_grams_words_and_pairs():
    texts = ["Ab ab, cd", "", None, "x" * 700, "é | 12"]
    got = quality.features(pa.array(texts))
    assert got.shape == (5, quality.WIDTH)
    for t, row in zip(texts, got):
        raw = (t or "").encode()
        w = [x.lower() for x in words(t)]
        for part, total in ((row[: quality.GRAMS], max(0, len(raw) - 2)), (row[quality.GRAMS :][: quality.WORDS], len(w)), (row[quality.GRAMS + quality.WORDS :][: quality.PAIRS], max(0, len(w) - 1))):
            assert (part.astype(float) ** 2).sum() == pytest.approx(total / (total + quality.PRIOR_COUNT), abs=1e-5)
    assert np.array_equal(got[1], got[2])


def test_windows_of_one_hash_are_told_apart():
    names = [b"aa", b"bb", b"cc", b"aa", b"bb", b"cc", b"aa", b"bb", b"dd"]
    ids = np.array([int.from_bytes(n, "big") for n in names], np.uint64)
    starts = np.arange(7)
    order, heads = superkmer.sort_windows(ids, starts, 3, np.zeros(7, np.uint64))
    groups = [sorted(order[a:b].tolist()) for a, b in zip(heads, [*heads[1:], 7])]
    want = defaultdict(list)
    for s in starts.tolist():
        want[tuple(names[s : s + 3])].append(s)
    assert sorted(groups) == sorted(want.values())


def _best_sum(text, score, unknown):
    """Brute force: the largest sum over all segmentations; a character without a piece of its own may stand alone."""
    chars = [c.encode() for c in text.decode()]
    ends = [0]
    for c in chars:
        ends.append(ends[-1] + len(c))
    best = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            if text[i:j] in score:
                best[j] = max(best[j], best[i] + score[text[i:j]])
        if j in ends:
            k = ends.index(j) - 1
            if chars[k] not in score:
                best[j] = max(best[j], best[ends[k]] + unknown)
    return best[-1]


@pytest.mark.parametrize("long", [False, True])
def test_viterbi_finds_the_best_sum_of_real_scores(long):
    rng = random.Random(11)
    vocabulary = {"".join(rng.choice("abcé日") for _ in range(rng.randint(1, 5))).encode() for _ in range(60)} - {"日".encode()}
    pieces_ = [(p, 300 + i, -rng.random() * 9) for i, p in enumerate(sorted(vocabulary))]
    auto = pieces.Automaton(pieces_, np.arange(256))
    score = {p: s for p, _, s in pieces_}
    names = {i: p for p, i, _ in pieces_}
    n = (700, 1500) if long else (1, 30)
    units = ["".join(rng.choice("abcé日x") for _ in range(rng.randint(*n))).encode() for _ in range(3 if long else 200)]
    ids, first = auto.segment(units)
    for k, u in enumerate(units):
        got = ids[first[k] : first[k + 1]].tolist()
        assert b"".join(names[i] if i >= 300 else bytes([i]) for i in got) == u
        total, rest = 0.0, [i for i in got if i < 300]
        total += sum(score[names[i]] for i in got if i >= 300)
        total += auto.unknown * len(bytes(rest).decode())
        assert total == pytest.approx(_best_sum(u, score, auto.unknown))
    if long:
        assert all(len(auto._parts(u)) > 1 and b"".join(auto._parts(u)) == u for u in units)


def test_long_text_without_spaces_takes_no_step_a_byte(docs):
    import time

    import public_tokenizers as P

    text = "".join(chr(0x4E00 + (i * 7919) % 5000) for i in range(100_000))
    began = time.time()
    ids = pieces.encode_batch([text], P.path("piece_bpe_32k.model"))[0]
    assert time.time() - began < 30 and pieces.decode(ids, P.path("piece_bpe_32k.model")) == text


def thue_morse(a, b, doublings):
    """Two texts of which a polynomial modulo a power of two is the same for any odd base."""
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def test_words_that_a_power_of_two_confuses(spark):
    s, t = thue_morse("a", "b", 10)
    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5 != 1][:5]
    held = next(i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5 == 1)
    pair = spark.createDataFrame([(1, s), (2, t)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.similar(pair).collect()) == [(1, 1), (2, 2)]
    runs = spark.createDataFrame([(1, " ".join([s] * 50)), (2, " ".join([t] * 50)), (3, " ".join([t] * 51))], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in superkmer.deduplicate(runs).collect()) == [(1, 0), (2, 0), (3, 51)]
    assert {r.n_removed for r in superkmer.deduplicate(runs.where("doc_id < 3"), bound=1).collect()} == {0}
    trained = spark.createDataFrame([(i, s) for i in ids[:4]] + [(held, t)], "doc_id long, text string")
    row = next(r for r in langmodel.score_documents(trained).collect() if r.held_out)
    assert (row.n_known, row.train_tokens) == (1, 8)
    assert row.base_score == pytest.approx(math.log10(0.5 / 9.5) + math.log10(4.5 / 9.5))
    assert [r.n_removed for r in sorted(prefixfree.remove_repeats(pair).collect())] == bytes_removed((s, t))


def bytes_removed(texts, width=200):
    """What a plain count of all windows removes from each text."""
    seen = Counter(x[i : i + width] for x in texts for i in range(len(x) - width + 1))
    return [len({j for i in range(len(x) - width + 1) if seen[x[i : i + width]] > 1 for j in range(i, i + width)}) for x in texts]


def test_units_that_a_power_of_two_confuses_keep_the_librarys_counts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    for a, b in ("-=", "ab", "01", "#*"):
        texts = pa.array(list(thue_morse(a, b, 11)))
        assert tokencount.count_batch(texts, path).tolist() == tokencount.count_batch(texts, path, whole=True).tolist()


def test_runs_of_one_hash_are_told_apart_by_their_bytes():
    rng = random.Random(5)
    words_ = [bytes(rng.choice(b"ab") for _ in range(rng.choice([1, 3, 8, 9, 30, 70, 200]))) for _ in range(3000)]
    data = np.frombuffer(b" ".join(words_), np.uint8)
    start, end, _ = kernel.word_spans(data, np.array([0, len(data)]))
    names = kernel.told_apart(data, start, end, kernel.mix(kernel.word_hashes(data, np.array([0, len(data)]))[0] & kernel.U(7)))
    by = {}
    assert all(by.setdefault(w, n) == n for w, n in zip(words_, names.tolist())) and len(set(by.values())) == len(by)
