"""Quality rules, lines first (operator 12).

Every line with a word is judged by itself:

* punctuation: its last word, or one in SENTENCE of its words at least, ends like
  a sentence (a mark of END, perhaps before quotes or brackets), no more than
  SHOUTED % end in ! or ?, and symbols are no more than SYMBOLS % of its words'
  characters;
* navigation: separators are no more than SEPARATED % of its words, and a line of
  up to SHORT words holds none of the menu phrases;
* boilerplate: a line of up to LONG words holds none of the boilerplate phrases.

Lines that fail are removed, and a document that loses more than LOST % of its
words is rejected. Besides, a document is rejected for what its whole text shows
(``base_failed``): fewer than 20 words, or more than 30 % of them in 8-word
windows that the text holds twice.

Texts are worked off in slices of whole documents; one text's lines and words
lie in one task, and nothing is shuffled. Words and windows are compared exactly:
words of one hash by their bytes, windows by numbers of pairs, fours and eights.

Defined results: null or empty text has no words, fails the base and keeps
nothing; repeated rows and null doc_ids are rows like any others; a line may be
as long as its text; extra columns are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import frugal

# Fixed values of the line rules.
END = ".!?…:;。！？；："
CLOSE = "\"'“”’»)]"
SENTENCE, SHOUTED, SYMBOLS, SEPARATED, SHORT, LONG, LOST = 60, 30, 15, 15, 6, 40, 50
SEPARATORS = ["|", "»", "›", "•", "·", ">", "→", "/"]
MENU = ["home", "menu", "log in", "login", "sign in", "sign up", "next page", "previous page", "back to top", "read more", "skip to content", "site map"]
BOILERPLATE = ["all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "we use cookies", "enable javascript", "lorem ipsum", "click here", "subscribe to our newsletter", "powered by", "licensed under"]

WORD = r"[^\x20\x09-\x0D]+"
ENDING = rf"[{re.escape(END)}][{re.escape(CLOSE)}]*$"
SHOUT = rf"[!?][{re.escape(CLOSE)}]*$"
SYMBOL = r"[#*$%&|<>]"


def phrase(phrases: list[str]) -> str:
    """A pattern of any of these as whole words, any case of A-Z."""
    return r"(?i)(^|[^a-z])(" + "|".join(phrases) + r")([^a-z]|$)"


_word, _ending, _shout, _symbol, _menu, _boiler = (re.compile(p) for p in (WORD, ENDING, SHOUT, SYMBOL, phrase(MENU).replace("(?i)", "(?ia)"), phrase(BOILERPLATE).replace("(?i)", "(?ia)")))
_separators = frozenset(SEPARATORS)


def line_stays(line: str, words: list[str]) -> bool:
    """Does a line with these words (at least one) pass the rules?"""
    n = len(words)
    if not _ending.search(words[-1]) and SENTENCE * sum(_ending.search(w) is not None for w in words) < n:
        return False
    if 100 * sum(w in _separators for w in words) > SEPARATED * n:
        return False
    if ("!" in line or "?" in line) and 100 * sum(_shout.search(w) is not None for w in words) > SHOUTED * n:
        return False
    if 100 * len(_symbol.findall(line)) > SYMBOLS * sum(map(len, words)):
        return False
    return not (n <= SHORT and _menu.search(line)) and not (n <= LONG and _boiler.search(line))


def clean(text: str) -> tuple[int, int, int, list[str]]:
    """Lines with a word that repeat an earlier one, lines with a word that fail, their words, and the lines that stay (those without a word, too)."""
    seen, again, failed, lost, kept = set(), 0, 0, 0, []
    judged: dict[str, tuple[bool, int]] = {}
    for line in text.split("\n"):
        if line not in judged:
            words = _word.findall(line)
            judged[line] = (not words or line_stays(line, words), len(words))
        stays, n = judged[line]
        if n:
            again += line in seen
            seen.add(line)
        if stays:
            kept.append(line)
        else:
            failed += 1
            lost += n
    return again, failed, lost, kept


_IN_WORD = np.ones(256, bool)
_IN_WORD[list(K.SPACE)] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, names: np.ndarray, window: int = 8) -> np.ndarray:
    """Words of every text that lie in a window of so many words (a power of two) which the text holds twice or more."""
    if first[-1] < window:
        return np.zeros(len(first) - 1, np.int64)
    ids = np.unique(names, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < window:
        ids = np.unique(ids[:-width] * (int(ids.max()) + 1) + ids[width:], return_inverse=True)[1].astype(np.int64)
        width *= 2
    at = np.flatnonzero(K.within(first, window, len(ids)))
    _, back, count = np.unique(K.owner(first)[at] * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
    hit = at[count[back] > 1]
    by = np.concatenate(([0], np.cumsum(K.covered(hit, hit + window, int(first[-1])))))
    return by[first[1:]] - by[first[:-1]]


def _counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    start, end, first = K.word_spans(data, offsets)
    names = K.exact_names(data, start, end, K.word_names(data, start, end))

    def each(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))[offsets]
        return np.diff(sums)

    chars = _IN_WORD[data] & ((data & 0xC0) != 0x80)
    return {"n_words": np.diff(first), "word_chars": each(chars), "n_symbols": each(_SYMBOL[data]), "n_repeat_words": repeated_words(data, start, end, first, names)}


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long, n_lost_words long"


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Counts and verdict of every row and, ``with_text``, clean_text: the lines that stay, null where the document is rejected."""
    frugal(docs.sparkSession)

    @K.tidy_batches
    def rate(batches):
        for batch in K.regroup(batches, 4 << 20):
            texts = batch.column("text")
            data, offsets = K.flat(texts)
            parts = [_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in K.slices(offsets)]
            out = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]} if parts else {}
            if not parts:
                continue
            lines = [clean(t.as_py() or "") for t in texts]
            again, failed, lost = (np.array(z, np.int64) for z in list(zip(*lines))[:3])
            n = out["n_words"]
            base = (n < 20) | (100 * out["n_repeat_words"] > 30 * n)
            kept = ~base & (100 * lost <= LOST * n)
            row = {"doc_id": batch.column("doc_id"), "n_words": n, "word_chars": out["word_chars"], "n_symbols": out["n_symbols"], "n_dup_lines": again, "n_repeat_words": out["n_repeat_words"], "base_failed": base, "kept": kept, "n_failed_lines": failed, "n_lost_words": lost}
            if with_text:
                row["clean_text"] = pa.array(["\n".join(x[3]) if k else None for x, k in zip(lines, kept)], pa.string())
            yield pa.RecordBatch.from_pydict(row)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(rate, _OUT + ", clean_text string" * with_text)
