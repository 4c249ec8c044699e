"""Vector codes, line rules and conversation tries against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from trialpulse.llm import annular, linerules, prefixtrie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- conversation trie


def talk(seed=1, n=160):
    rng = random.Random(seed)
    texts = ["hi there", "", None, "how are you  today", "fine\tthanks", "a b c d", "ok", "é ü"]
    rows = []
    for c in [i for i in range(n) if i % 7] + [-40, -39, -3, 1000, 1001]:
        shape = rng.random()
        turns = [0] * rng.randint(1, 6) if shape < 0.3 else [rng.randrange(3) for _ in range(rng.randint(1, 9))]
        if c % 5 == 0:
            turns = [0, 1, 0, 1]
        for k, t in enumerate(turns):
            rows.append((c, k, "user" if k % 2 == 0 else None, texts[t + (k % 2) * 3]))
    rows.append((None, 0, "user", "lost"))
    rows.append((1001, None, "system", "before all"))
    rng.shuffle(rows)
    return rows


def trie_by_hand(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((-math.inf if turn is None else turn, role or "", text or ""))
    for c in convs:
        convs[c].sort(key=lambda t: t[0])
    new = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = convs.get(c - int(math.fmod(c, 20)), [])[:h]
        new[c] = [t[1:] for t in head + turns[h:]]
    members = defaultdict(list)
    for c, seq in new.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(new[c]) == len(p)).encode()).hexdigest() for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends[p]) for p, m in members.items())


@pytest.mark.parametrize("block_bytes", [1 << 22, 100])
def test_trie_has_every_prefix_once(spark, block_bytes):
    rows = talk()
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, place int").repartition(5)
    got = prefixtrie.trie(turns, block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect())) == trie_by_hand(rows)


@pytest.mark.parametrize("rows", [[(3, 0, "user", "only one")], [(3, 0, None, None)], [(c, 0, "u", "same") for c in range(50)], [(c, t, "u", "same") for c in range(9) for t in range(c + 1)]])
def test_small_tries(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefixtrie.trie(turns, block_bytes=20).collect())) == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    turns = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefixtrie.trie(turns).collect() == prefixtrie.trie(turns.limit(0)).collect() == []


def test_nearest_smaller_values_by_block_minima():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 100):
        v = rng.integers(0, 9, n)
        m = prefixtrie.Minima(v)
        at = np.arange(n)
        for x in range(10):
            want = np.full(n, x)
            assert m.nearest_below(at, want, True).tolist() == [max((j for j in range(i) if v[j] < x), default=-1) for i in range(n)]
            assert m.nearest_below(at, want, False).tolist() == [min((j for j in range(i + 1, n) if v[j] < x), default=n) for i in range(n)]
        assert prefixtrie.smaller_before(v).tolist() == [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]
        assert prefixtrie.smaller_after(v).tolist() == [min((j for j in range(i + 1, n) if v[j] < v[i]), default=n) for i in range(n)]
        a, z = rng.integers(0, n + 1, (2, 50))
        assert m.over(a, z).tolist() == [min(v[i:j].tolist(), default=prefixtrie.MOST) for i, j in zip(a, z)]


# -- vector codes


def codes_by_hand(rows, parts=8, entries=16, rounds=6):
    kept = [(i, label, [math.floor(4096 * float(x)) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-max(len(v) for _, _, v in kept) // parts) * parts
    kept = [(i, label, v + [0] * (width - len(v))) for i, label, v in kept]
    w = width // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for _, _, v in kept:
                got[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(got[k]) for c in zip(*got[k])] if k in got else e for k, e in enumerate(books[p])]
    out, labels = [], Counter()
    for i, label, v in kept:
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
        labels[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, e, labels[label], digest) for i, code, e, label in out), key=str)


def vectors(n=300, dims=16):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 0.4) for _ in range(dims)] for _ in range(7)]
    rows = [(i * 3, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(1, None, 1), (2, [0.1] * 15 + [None], 1), (4, [0.1] * 15 + [float("nan")], 2), (5, [float("inf")] * 16, 2), (7, [0.25] * 16, 9), (8, [0.25] * 16, 9), (None, [0.5] * 16, 2), (30, [0.0] * 16, None)]
    return rows


@pytest.mark.parametrize("extra", [[], [(10, [0.5, -0.5, 0.125], 1), (11, [], 2), (13, [0.1] * 19, 2)], [(10, [3e18, -1e9] + [0.0] * 14, 1), (601, [4e14] * 16, 3)]])
def test_codes_are_those_of_plain_search(spark, extra):
    rows = vectors() + extra
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, c int").repartition(4)
    want = codes_by_hand(rows) if not extra or len(extra[0][1]) == 3 else codes_by_hand([(i, v and [None if x is None else x if not math.isfinite(x) else max(min(x, (1 << 63) / 4096 - 1), -(1 << 63) / 4096) for x in v], label) for i, v, label in rows])
    got = sorted((tuple(r) for r in annular.quantise(table).collect()), key=str)
    if extra and len(extra[0][1]) == 16:
        want = [(i, c, min(e, annular.MOST), min(t, annular.MOST), h) for i, c, e, t, h in want]
        assert [g[:2] for g in got if g[0] != 10] == [w[:2] for w in want if w[0] != 10]
    else:
        assert got == want


def test_few_vectors_and_none(spark):
    rows = [(5, [0.5] * 8, 1), (3, [-0.5] * 8, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted((tuple(r) for r in annular.quantise(table).collect()), key=str) == codes_by_hand(rows)
    assert annular.quantise(table.limit(0)).collect() == annular.quantise(table.where("vec_id = 9")).collect() == []


def test_the_annulus_is_narrow_and_loses_no_tie():
    rng = np.random.default_rng(2)
    book = rng.integers(-3000, 3000, (64, 4)) * np.arange(1, 65)[:, None] // 64
    book[40] = book[3]
    x = book[rng.integers(0, 64, 2000)] + rng.integers(-40, 40, (2000, 4))
    index, best, computed = annular.nearest(x, book)
    d = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert index.tolist() == d.argmin(1).tolist() and best.tolist() == d.min(1).tolist()
    assert computed < 0.35 * d.size
    ring = np.array([[3, 4], [5, 0], [-3, 4], [0, -5]])  # equal norms, equal distances
    assert annular.nearest(np.zeros((1, 2), np.int64), ring)[0].tolist() == [0]


# -- line rules

PROSE = "The first line of this text has quite a few words in it.\nAnother line follows, and it is as good as the one before!\n"
TEXTS = [
    None, "", " \n\t\n", "too short.", PROSE, PROSE + PROSE, PROSE + "no end here\n" * 2, PROSE + "Home | News | About | Contact | Help | More | Login | Search | Site map | Top",
    "menu home login\n" * 8 + PROSE, PROSE + "All rights reserved by us and by nobody else.", "be " * 50, "a b c d e f g h. " * 2 + "x" * 100, ("word. " * 3 + "\n") * 9, "HEY! " * 30 + "NOW!",
    "th*** wh%%% " * 20 + "end.", "one two three four five six seven eight nine ten eleven.\r\n" * 3, "日本語 の 文 です。" * 10, " ".join(f"w{i}" for i in range(19)) + ".", " ".join(f"w{i}" for i in range(20)) + '."', "x" * 3000 + ". " + " ".join(f"v{i}" for i in range(30)) + ".",
    PROSE.replace("\n", "\r\n") + "→ / | ok.\n", "\n".join(f"line {i} of many, all of them good." for i in range(40)),
]


def rules_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    base = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    lost = sum(len(WORD.findall(x)) for x in lines if not linerules.line_stays(x, WORD.findall(x)))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), base, not base and 100 * lost <= 50 * len(words), lost


def test_line_rules(spark):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(TEXTS)] + [(None, PROSE, 1, "k")] * 2, "doc_id long, text string, n_words int, kept string").repartition(3)
    got = {r.doc_id: r for r in linerules.judge(docs, with_text=True).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.n_lost_words) == rules_by_hand(t), (i, t)
    assert [got[i].clean_text.strip() for i in (4, 6, 9)] == [PROSE.strip()] * 3
    assert got[7].n_failed_lines == 1 and got[1].clean_text is None
    assert linerules.judge(docs).count() == len(TEXTS) + 2 and linerules.judge(docs.limit(0)).count() == 0


@pytest.mark.parametrize("line, stays", [("A sentence of five words.", True), ("A heading without an end", False), ("It ends. And then goes on without", True), ("no " * 70 + "end.", True), ("no. " + "no " * 70, False), ('"Is it?" she asked.', True), ("Go! Now! Run! Fast! Away!", False), ("one | two | three | four.", False), ("th*** is### a$$$ bad%%% line.", False), ("Back to top.", False), ("Home is where the heart is, they say, and they are right.", True), ("Read our privacy policy before you go on.", False), ("Er sagte „Gut.“", True), ("Fin…", True)])
def test_each_rule(line, stays):
    assert linerules.line_stays(line, WORD.findall(line)) is stays


def test_repeated_windows_are_exact():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "b"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    data, offsets = linerules.K.flat(pa.array(texts))
    assert linerules._counts(data, offsets)["n_repeat_words"].tolist() == [rules_by_hand(t)[4] for t in texts]
