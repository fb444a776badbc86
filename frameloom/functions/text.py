"""Word alignment in Arrow batches, and hypothesis features as column expressions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from . import spoken

SMALL = 4096  # cells up to which a plain loop is faster


def words(c: Column | str) -> Column:
    """Runs without white space; null stays null."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def align_words(ref: list, hyp: list) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of two sequences. A match takes the diagonal; of equal costs a substitution goes before a
    deletion, that before an insertion."""
    row = [(j, 0, 0, j) for j in range(len(hyp) + 1)]
    for r in ref:
        c, s, d, n = row[0]
        new = [(c + 1, s, d + 1, n)]
        for j, h in enumerate(hyp):
            if r == h:
                new.append(row[j])
                continue
            (a, b, e) = row[j], row[j + 1], new[j]
            if a[0] <= b[0] and a[0] <= e[0]:
                new.append((a[0] + 1, a[1] + 1, a[2], a[3]))
            elif b[0] <= e[0]:
                new.append((b[0] + 1, b[1], b[2] + 1, b[3]))
            else:
                new.append((e[0] + 1, e[1], e[2], e[3] + 1))
        row = new
    return row[-1][1:]


def align_codes(ref: np.ndarray, hyp: np.ndarray) -> tuple[int, int, int]:
    """The same of two arrays of whole numbers, one anti-diagonal at a time: its cells only need the two before it. Memory is linear."""
    m, n = len(ref), len(hyp)
    deletion, insertion = 1 << 21, 1 << 42  # the counts of a path in one number, substitutions lowest
    back = hyp[::-1]
    cost = [np.zeros(m + 1, np.int64) for _ in range(3)]
    path = [np.zeros(m + 1, np.int64) for _ in range(3)]
    for k in range(1, m + n + 1):
        (c, c1, c2), (p, p1, p2) = ([x[(k - i) % 3] for i in range(3)] for x in (cost, path))
        lo, hi = max(1, k - n), min(m, k - 1)
        if lo <= hi:
            here, before = slice(lo, hi + 1), slice(lo - 1, hi)
            same = ref[before] == back[n - k + lo : n - k + hi + 1]
            first = (c2[before] <= c1[before]) & (c2[before] <= c1[here])
            second = c1[before] <= c1[here]
            c[here] = np.where(same, c2[before], 1 + np.where(first, c2[before], np.where(second, c1[before], c1[here])))
            p[here] = np.where(same, p2[before], np.where(first, p2[before] + 1, np.where(second, p1[before] + deletion, p1[here] + insertion)))
        if k <= n:
            c[0], p[0] = k, k * insertion
        if k <= m:
            c[k], p[k] = k, k * deletion
    end = int(path[(m + n) % 3][m])
    return end % deletion, end // deletion % deletion, end // insertion


COUNTS = "struct<c:int,s:int,d:int,n:int>"


def _align_batch(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Words get numbers for the whole batch; null arrays count as empty ones."""
    codes = pa.concat_arrays([ref.flatten(), hyp.flatten()]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    sizes = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in (ref, hyp)]
    ends = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in sizes]
    lead = ends[0][-1]
    out = np.zeros((len(ref), 3), np.int32)
    for i in range(len(ref)):
        a, b = codes[ends[0][i] : ends[0][i + 1]], codes[lead + ends[1][i] : lead + ends[1][i + 1]]
        out[i] = align_words(a.tolist(), b.tolist()) if len(a) * len(b) <= SMALL else align_codes(a, b)
    columns = [out.sum(axis=1, dtype=np.int32), out[:, 0], out[:, 1], out[:, 2]]
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c), pa.int32()) for c in columns], ["c", "s", "d", "n"])


def alignment(ref: Column | str, hyp: Column | str) -> Column:
    """struct(c, s, d, n): cost, substitutions, deletions and insertions of two arrays of words, in Arrow batches, for texts of any length."""

    def run(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        return _align_batch(ref, hyp)

    return F.arrow_udf(run, COUNTS)(ref, hyp)


def word_distance(cost: Column, ref: Column, hyp: Column) -> Column:
    """Edits over the longer text's words; 0 for two empty texts."""
    longest = F.greatest(F.size(ref), F.size(hyp))
    return F.when(longest == 0, F.lit(0.0)).otherwise(cost / longest)


def repeated_ngram_fraction(words_: str, n: int) -> Column:
    """The share of n-gram places whose n-gram stands elsewhere too; 0 for fewer than n words. ``words_`` names a column."""
    if n < 1:
        raise ValueError("n must be positive")
    grams = f"transform(slice({words_}, 1, greatest(size({words_}) - {n - 1}, 0)), (gram_word, gram_at) -> slice({words_}, gram_at + 1, {n}))"
    # sorted, equal n-grams are neighbours
    again = f"aggregate(array_sort({grams}), named_struct('last', cast(null as array<string>), 'run', 0, 'n', 0), (a, g) -> if(a.last <=> g, named_struct('last', g, 'run', a.run + 1, 'n', a.n + if(a.run = 1, 2, 1)), named_struct('last', g, 'run', 1, 'n', a.n)), a -> a.n)"
    return F.when(F.size(words_) < n, F.lit(0.0)).otherwise(F.expr(again) / (F.size(words_) - (n - 1)))


def retry_seed(*parts: Column) -> Column:
    """The first four bytes of the SHA-256 of the parts joined by zero bytes, without the sign bit."""
    joined = F.concat_ws("\0", *parts)
    return F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def row_digest(*columns: str) -> Column:
    """SHA-256 of the sorted columns as compact JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def length_bin(n: Column) -> Column:
    return F.when(n <= 4, "1-4").when(n <= 9, "5-9").when(n <= 19, "10-19").otherwise("20+")


def timestamp_text(seconds: Column) -> Column:
    """MM:SS.s, not below 0."""
    s = F.greatest(seconds, F.lit(0.0))
    minutes = F.floor(s / 60)
    return F.format_string("%02d:%04.1f", minutes, s - minutes * 60)


# English contractions that aren't made by their ending, endings, titles, and words that only fill a pause
CONTRACTIONS = {"won't": "will not", "can't": "can not", "shan't": "shall not", "ain't": "are not", "let's": "let us", "y'all": "you all", "gonna": "going to", "wanna": "want to", "gotta": "got to"}
ENDINGS = {"n't": "not", "'re": "are", "'ve": "have", "'ll": "will", "'d": "would", "'m": "am", "'s": "is"}
PRONOUNS = ("it", "he", "she", "that", "there", "here", "what", "who", "where", "how")
TITLES = {"mr": "mister", "mrs": "missus", "dr": "doctor", "st": "saint", "prof": "professor"}
FILLERS = ("hmm", "mm", "mhm", "uh", "um")


def english_rules() -> list[tuple[str, str]]:
    """(pattern, replacement) in the order of their use, in syntax that Java and RE2 read alike. Text is in lower case by then."""
    edge = r"(^|[^a-z0-9'])"
    rules = [("[’`´]", "'"), (r"\[[^\]]*\]|<[^>]*>|\([^)]*\)", " ")]
    rules += [(edge + rf"(?:{'|'.join(FILLERS)})\b", "$1 "), (r"\s+'(s|re|ve|ll|d|m|t)\b", "'$1")]
    rules += [(edge + w.replace("'", "['’]") + r"\b", "$1" + full) for w, full in CONTRACTIONS.items()]
    rules += [(rf"(\b(?:{'|'.join(PRONOUNS)}))'s\b", "$1 is"), (r"n't\b", " not"), (r"\bi'm\b", "i am")]
    rules += [(rf"{e}\b", f" {full}") for e, full in ENDINGS.items() if e not in ("n't", "'s", "'m")]
    rules += [(edge + t + r"\.? ", f"$1{full} ") for t, full in TITLES.items()]
    rules += [(r"([0-9]),([0-9])", "$1$2"), (r"\.([^0-9]|$)", " $1"), (r"[^a-z0-9'.%$€£À-ɏḀ-ỿ]+", " "), (r"(^|\s)'+|'+(\s|$)", "$1 $2")]
    return rules


def _normalized(d: spoken.Dialect, c: str, numbers: bool, regional: bool) -> str:
    out = f"lower({c})"
    for pattern, replacement in english_rules():
        out = d.replace(out, pattern, replacement.replace("$", "\\"))
    out = d.replace(out, r"\s+", " ")
    if numbers:
        out = spoken.numbers(d, out)
    if regional:
        out = spoken.spellings(d, out)
    return f"trim({d.replace(out, ' +', ' ')})"


def normalized_english(c: str, numbers: bool = True, regional: bool = True) -> Column:
    """The column named ``c`` as it is compared in error rates: lower case, without bracketed remarks, fillers and punctuation, contractions and titles written out, thousands'
    commas dropped, spelled numbers in digits, one regional spelling (see ``functions.spoken``), single spaces. Null stays null; no Python runs.

    The steps and their order are those of the published Whisper normalizer for English, as error rates of that model are given on texts so normalized; its tables of
    fillers, contractions and titles overlap with these. The transducer of numbers and the spelling rules are this library's own, and differ from it in rare phrases."""
    return F.expr(_normalized(spoken.SPARK, f"`{c}`", numbers, regional))


def normalized_english_sql(c: str) -> str:
    return _normalized(spoken.DUCKDB, c, True, True)


def token_count(c: Column | str, path: str) -> Column:
    """Tokens of each text by the tokenizer file at ``path``, without special ones; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        found = _tokenizer(path).encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        return pa.array([None if t is None else len(e.ids) for t, e in zip(texts.to_pylist(), found)], pa.int64())

    return F.arrow_udf(run, "long")(c)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
