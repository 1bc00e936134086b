"""Line-first quality rules: lines are judged first, failing ones are left out, then documents that lose too much go.

Base counts of a document: word_chars (code points in words), n_symbols (characters of #*$%&|<>), n_dup_lines (lines with a
word that equal an earlier one) and n_repeat_words (words in 8-word windows that occur twice or more). It fails at once
with fewer than 20 words, or if more than 30 % of its words repeat in windows.

A line with words fails a rule if
- punctuation: it has `LONG` words or more, none of which ends in terminal punctuation;
- shouting: it has five words or more, and more than 70 % of its ASCII letters are capitals;
- navigation: more than 15 % of its words are separators such as | or >, or it holds `LINKS` or more of them;
- symbols: more than 8 % of its word characters are of #*$%&|<>;
- boilerplate: a fifth or more of its words, and two at least, are of the boilerplate list.
A document is rejected if the lines left hold less than half of its word characters.

Edge cases: null and empty texts and texts without words have counts of 0 and fail; repeated rows get equal results; other
columns don't matter; a line is what stands between \\n, so a \\r belongs to its line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import BLACK, U64, bounded, mix, runs, span_hashes, steps, utf8

LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
LONG, LINKS, KEPT_SHARE = 40, 8, 0.5
#: Words of navigation, legal and account lines, in English, German, Spanish and French.
BOILERPLATE = (
    "cookie", "cookies", "javascript", "copyright", "login", "logout", "subscribe", "newsletter", "sitemap", "privacy", "reserved", "rights", "terms", "menu",
    "datenschutz", "impressum", "anmelden", "abmelden", "registrieren", "agb", "urheberrecht", "privacidad", "reservados", "derechos", "suscribirse",
    "suscribase", "registrarse", "confidentialit\u00e9", "mentions", "abonner", "inscription", "r\u00e9serv\u00e9s", "droits", "connexion",
)


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOLS, TERMINAL, UPPER, LOWER, SEPARATORS = _set(b"#*$%&|<>"), _set(b".!?:;\"')]"), _set(bytes(range(65, 91))), _set(bytes(range(97, 123))), _set(b"|>/-*")


def _list() -> np.ndarray:
    raw = [w.encode() for w in BOILERPLATE]
    ends = np.cumsum([0, *map(len, raw)])
    return np.sort(span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends[:-1], ends[1:], True))


def repeats(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value, whether an earlier one of its group equals it, and whether any other one does."""
    s = np.lexsort((values, groups))
    g, v = groups[s], values[s]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    later, some = np.empty(len(s), bool), np.empty(len(s), bool)
    later[s], some[s] = same[:-1], same[:-1] | same[1:]
    return later, some


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines; every row with bytes has one at least."""
    cuts = np.flatnonzero(data == 10)
    full = np.flatnonzero(np.diff(offsets))
    starts = np.unique(np.concatenate([offsets[full], cuts + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    return starts, ends - ((ends > starts) & (data[ends - 1] == 10))


def judge(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and verdicts of each row, and the line spans with their verdicts."""
    rows = len(offsets) - 1
    per = lambda x, size, w=None: np.bincount(x, w, minlength=size).astype(np.int64)
    out = {}
    doc_of_byte = np.repeat(np.arange(rows), np.diff(offsets))
    starts, ends, doc = runs(BLACK[data], offsets)
    ls, le = line_spans(data, offsets)
    lines = len(ls)
    line = np.searchsorted(ls, starts, "right") - 1
    chars = BLACK[data] & ((data & 0xC0) != 0x80)
    before = np.concatenate([[0], np.cumsum(chars)])
    width = before[ends] - before[starts]
    out["n_words"] = per(doc, rows)
    out["word_chars"] = per(doc, rows, width)
    out["n_symbols"] = per(doc_of_byte[SYMBOLS[data]], rows)
    words_in = per(line, lines)
    worded = np.flatnonzero(words_in)
    line_doc = np.searchsorted(offsets, ls, "right") - 1
    later, _ = repeats(line_doc[worded], span_hashes(data, ls[worded], le[worded]))
    out["n_dup_lines"] = per(line_doc[worded][later], rows)
    h = span_hashes(data, starts, ends)
    out["n_repeat_words"] = np.zeros(rows, np.int64)
    n = len(h) - WINDOW + 1
    if n > 0:
        with np.errstate(over="ignore"):
            grams = np.zeros(n, U64)
            for k in range(WINDOW):
                grams += h[k : k + n] * (mix(np.array([k + 1], U64))[0] | U64(1))
        at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
        _, some = repeats(doc[at], grams[at])
        marks = np.zeros(len(h) + 1, np.int64)
        np.add.at(marks, at[some], 1)
        np.add.at(marks, at[some] + WINDOW, -1)
        out["n_repeat_words"] = per(doc[np.cumsum(marks[:-1]) > 0], rows)
    # the rules, line by line
    line_of_byte = np.repeat(np.arange(lines), np.diff(np.append(ls, len(data)))) if lines else np.zeros(0, np.int64)
    count = lambda what: per(line_of_byte[what[data]], lines)
    upper, lower, symbols = count(UPPER), count(LOWER), count(SYMBOLS)
    line_chars = per(line, lines, width)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    closed = per(line[TERMINAL[last]], lines)
    links = per(line[(ends - starts == 1) & SEPARATORS[last]], lines)
    known = per(line[np.isin(span_hashes(data, starts, ends - (TERMINAL[last] | (last == 44)), True), _list())], lines)
    bad = (words_in >= LONG) & (closed == 0)
    bad |= (words_in >= 5) & (upper > 0.7 * (upper + lower))
    bad |= (links > 0.15 * words_in) | (links >= LINKS)
    bad |= symbols > 0.08 * line_chars
    bad |= (known >= 2) & (5 * known >= words_in)
    bad &= words_in > 0
    left = per(line_doc[~bad], rows, line_chars[~bad]) if lines else np.zeros(rows, np.int64)
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
    out["n_lines"], out["n_bad_lines"] = per(line_doc[worded], rows), per(line_doc[bad], rows)
    out["kept"] = ~out["base_failed"] & (left >= KEPT_SHARE * out["word_chars"])
    out["_lines"] = (ls, le, line_doc, bad)
    return out


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines")


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", text: bool = True) -> DataFrame:
    """(id, counts, base_failed, kept, n_lines, n_bad_lines, clean_text) for each row; clean_text (only with `text`) has the lines that pass."""
    picked = bounded(docs).select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = f"`{id_col}` {picked.schema[0].dataType.simpleString()}, " + ", ".join(f"{c} {'boolean' if c in ('base_failed', 'kept') else 'bigint'}" for c in COLUMNS) + ", clean_text string" * text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in steps(offsets):
                raw, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                got = judge(raw, own)
                arrays = [batch.column(0).slice(i, j - i), *(pa.array(got[c]) for c in COLUMNS)]
                if text:
                    ls, le, doc, bad = got["_lines"]
                    parts: list[list[bytes]] = [[] for _ in range(j - i)]
                    for a, b, d in zip(ls[~bad], le[~bad], doc[~bad]):
                        parts[d].append(raw[a:b].tobytes())
                    arrays.append(pa.array([b"\n".join(p).decode() for p in parts], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *COLUMNS, *(["clean_text"] * text)])

    return picked.mapInArrow(run, schema)
