"""Numbers as they are spoken, and regional spellings, to one written form: a transducer over words as a fold of built-in functions.

A text is cut where phrases of number words begin and end (one regular expression), and only these phrases are folded, word by word, so the work is linear in a text whose
phrases are short. The same fold is written as Spark SQL and as DuckDB SQL.

The transducer holds the number it is in: digits spoken before it (``pre``), the sum of its closed groups (``tot``) and their last scale (``cap``), the open group (``cur``),
decimals (``dec``), the kind of its last word (``k``, empty outside a number), and a word that waits (``pend``). What each word does:

* unit (0-9), teen (10-19), ten (20-90): added to an open place ("twenty one", "hundred five", "thousand ten"); after a number below 100 without scale its digits are appended
  ("nineteen eighty four" is 1984, "one two three" is 123); after "point" a unit is a decimal; else another number begins;
* "hundred" multiplies an open group below 100, a scale (thousand to trillion) one below a million that stands under no smaller scale ("two thousand million" is two numbers), and decimals
  where the product is whole ("three point five million"); alone they are numbers themselves;
* "and" after hundred or a scale is dropped if the number goes on; "point" stays a word if no unit follows; "and a half" is "point five";
* ordinals end a number ("twenty first" is 21st), as do currencies and "percent", which become marks ("five dollars" is $5, "five percent" 5%); "$2 and ¢5" is $2.05;
* "a" before hundred or a scale is one; digits (at most 15, with at most 9 decimals) are numbers too: "3 million", "$2.5 million".

Regional spellings are rules over stems and endings (see ``SPELLINGS``), to the forms with -or, -ize, -er, -ed, -se and the like.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# English number words
UNITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
TEENS = ("ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
SCALES = ("thousand", "million", "billion", "trillion")
ODD_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
MARKS = {"dollar": "$", "dollars": "$", "pound": "£", "pounds": "£", "euro": "€", "euros": "€", "cent": "¢", "cents": "¢", "percent": "%"}

#: stems, endings of one region, what these become; (stem)(ending) is a whole word, and $ in the third is a further ending
SPELLINGS = (
    ("arm|behavi|cand|clam|col|demean|endeav|enam|fav|ferv|flav|glam|harb|hon|hum|lab|neighb|od|parl|ranc|rig|rum|sav|splend|tum|val|vap|vig", "our", "or", "|s|ed|ing|ful|less|able|ably|er|ers|ite|ites|hood|hoods|y|al"),
    ("agon|apolog|author|capital|categor|character|civil|colon|critic|custom|digit|emphas|energ|equal|familiar|final|formal|general|global|harmon|hospital|human|ideal|immun|initial|jeopard|legal|local|maxim|memor|minim|mobil|modern|neutral|normal|optim|organ|penal|personal|polar|popular|prior|priorit|random|real|recogn|reorgan|revolution|special|stabil|standard|steril|summar|symbol|sympath|synchron|terror|urban|util|visual", "is", "iz", "e|es|ed|ing|er|ers|ation|ations|able"),
    ("anal|paral|catal", "ys", "yz", "e|es|ed|ing|er|ers"),
    ("cent|fib|lit|lust|mit|meag|somb|spect|theat|kilomet|centimet|millimet|met", "re", "er", "|s"),
    ("cancel|channel|counsel|dial|equal|fuel|label|level|marvel|model|panel|quarrel|refuel|rival|signal|travel|tunnel|unravel", "l", "", "ed|ing|er|ers"),
    ("def|off|pret", "ence", "ense", "|s"),
    ("licen", "ce", "se", "|s|d"),
    ("analog|catalog|dialog|monolog|epilog|prolog", "ue", "", "|s"),
    ("gr", "ey", "ay", "|s|ed|ing"),
    ("m|sm", "ould", "old", "|s|er|ed|ing|y"),
    ("pl", "ough", "ow", "|s|ed|ing"),
    ("program", "me", "", "|s"),
    ("pr", "actis", "actic", "e|es|ed|ing"),
    ("s", "ceptic", "keptic", "|s|al|ism"),
    ("alumin", "ium", "um", ""),
    ("t", "yre", "ire", "|s"),
    ("che", "que", "ck", "|s"),
    ("jewel", "lery", "ry", ""),
    ("p", "yjama", "ajama", "|s"),
    ("enrol|instal|fulfil|distil", "", "l", "|s|ment|ments"),
    ("skil|wil", "", "l", "ful|fully"),
)


def ordinal(word: str) -> str:
    return ODD_ORDINALS.get(word) or (word[:-1] + "ieth" if word.endswith("y") else word + "th")


def word_values() -> dict[str, tuple[str, int]]:
    """Number words with their kinds (u, t, d, h, s, and o before them for ordinals) and values."""
    out = {w: ("u", i) for i, w in enumerate(UNITS)} | {w: ("t", i + 10) for i, w in enumerate(TEENS)} | {w: ("d", 10 * i + 20) for i, w in enumerate(TENS)}
    out |= {"hundred": ("h", 100)} | {w: ("s", 1000 ** (i + 1)) for i, w in enumerate(SCALES)}
    return out | {ordinal(w): ("o" + k, v) for w, (k, v) in out.items() if v}


_DIGITS = r"[0-9]{1,15}(?:\.[0-9]{1,9})?"
STATE = ("out", "pre", "tot", "cur", "cap", "dec", "k", "pend")


class Dialect:
    """How the two SQLs write what they write differently."""

    def __init__(self, struct: Callable[[dict], str], text: str, fold: str, each: str, split: str, cut: str, group: str, flags: str):
        self.struct, self.text, self.fold, self.each, self.split, self.cut, self.group, self.flags = struct, text, fold, each, split, cut, group, flags

    def replace(self, c: str, pattern: str, by: str) -> str:
        quoted = [("'" + x.replace("\\", "\\\\" if self.text == "string" else "\\").replace("'", "''" if self.text != "string" else "\\'") + "'") for x in (pattern, by.replace("\\", self.group))]
        return f"regexp_replace({c}, {quoted[0]}, {quoted[1]}{self.flags})"


SPARK = Dialect(
    lambda f: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in f.items()) + ")", "string",
    "aggregate({list}, {zero}, (s, t) -> {step})", "transform({list}, (x, i) -> if(i % 2 = 1, {odd}, x))", "transform(split(trim({c}), ' +'), w -> {of})", "split({c}, '\\u0001')", "$", "",
)
DUCKDB = Dialect(
    lambda f: "struct_pack(" + ", ".join(f'"{k}" := {v}' for k, v in f.items()) + ")", "VARCHAR",
    "list_reduce(list_prepend({zero}, {list}), lambda s, t: {step})", "list_transform({list}, lambda x, i: CASE WHEN i % 2 = 0 THEN {odd} ELSE x END)", "list_transform(string_split_regex(trim({c}), ' +'), lambda w: {of})", "string_split({c}, chr(1))", "\\", ", 'g'",
)


def _word(d: Dialect) -> str:
    """A word as the transducer's record: its text, kind and value; of digits the leading zeros and decimals, of marks what stands before and after a number."""
    values = word_values()
    kind = " ".join(f"WHEN w IN ({', '.join(repr(w) for w, (k, _) in values.items() if k == kind)}) THEN '{kind}'" for kind in dict.fromkeys(k for k, _ in values.values()))
    kind = f"CASE {kind} WHEN w = 'and' THEN 'a' WHEN w = 'point' THEN 'p' WHEN w IN ({', '.join(map(repr, MARKS))}) THEN 'c' WHEN contains(w, '.') THEN 'm' ELSE 'l' END"
    value = "CASE " + " ".join(f"WHEN w = '{w}' THEN {v}" for w, (_, v) in values.items())
    value += f" WHEN regexp_like(w, '^[0-9]') THEN cast(regexp_extract(w, '^[0-9]+', 0) AS bigint) ELSE 0 END"
    front = "CASE " + " ".join(f"WHEN w = '{w}' THEN '{m}'" for w, m in MARKS.items() if m != "%") + " WHEN regexp_like(w, '^0[0-9]') THEN regexp_extract(w, '^(0+)[0-9]', 1) ELSE '' END"
    after = r"CASE WHEN w = 'percent' THEN '%' WHEN contains(w, '.') THEN regexp_extract(w, '[0-9]+$', 0) ELSE '' END"
    fields = {"out": "w", "pre": front, "tot": "cast(0 AS bigint)", "cur": f"cast({value} AS bigint)", "cap": "cast(0 AS bigint)", "dec": after, "k": kind, "pend": "''"}
    out = d.struct(fields)
    return out if d is SPARK else out.replace("regexp_like(", "regexp_matches(")


def _step(d: Dialect) -> str:
    s = {f: f"s.{f}" for f in STATE}
    number = f"concat(s.pre, cast(s.tot + s.cur AS {d.text}), CASE WHEN s.dec = '' THEN '' ELSE concat('.', s.dec) END)"
    ended = f"CASE WHEN s.k = '' THEN s.out ELSE concat(s.out, {number}, ' ', CASE WHEN s.pend = '' THEN '' ELSE concat(s.pend, ' ') END) END"
    zero = {"pre": "''", "tot": "cast(0 AS bigint)", "cur": "cast(0 AS bigint)", "cap": "cast(0 AS bigint)", "dec": "''", "k": "''", "pend": "''"}
    after = lambda **changes: d.struct(s | changes)
    outside = lambda out: d.struct({"out": out} | zero)
    scale = "CASE WHEN t.k = 's' THEN t.cur ELSE cast(0 AS bigint) END"
    begun = d.struct({"out": ended, "pre": "t.pre", "tot": scale, "cur": "CASE WHEN t.k = 's' THEN cast(0 AS bigint) ELSE t.cur END", "cap": scale, "dec": "t.dec", "k": "t.k", "pend": "''"})
    suffix = lambda n: f"CASE WHEN {n} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END"
    small = "s.tot = 0 AND s.cur < 100"
    hundred = "s.k IN ('u', 't', 'd', 'l') AND s.pre = '' AND s.cur BETWEEN 1 AND 99"
    scaled = "s.k IN ('u', 't', 'd', 'h', 'l') AND s.pre = '' AND s.dec = '' AND s.pend = '' AND s.cur BETWEEN 1 AND 999999 AND (s.cap = 0 OR t.cur < s.cap)"
    places = f"cast(length(cast(t.cur AS {d.text})) - 1 AS int)"
    decimal = f"s.k IN ('f', 'm') AND s.pre = '' AND s.tot = 0 AND s.cur < 1000000 AND length(s.dec) <= {places}"
    ordinal_ = f"""CASE WHEN (t.k = 'ou' AND s.k IN ('d', 'h', 's')) OR (t.k IN ('ot', 'od') AND s.k IN ('h', 's')) THEN s.tot + s.cur + t.cur
      WHEN t.k = 'oh' AND {hundred} THEN s.tot + s.cur * 100 WHEN t.k = 'os' AND {scaled} THEN s.tot + s.cur * t.cur END"""
    return f"""CASE
      WHEN (t.k = 'u' AND t.cur > 0 AND s.k IN ('d', 'h', 's')) OR (t.k IN ('t', 'd') AND s.k IN ('h', 's')) THEN {after(cur="s.cur + t.cur", k="t.k", pend="''")}
      WHEN t.k = 'u' AND s.k IN ('p', 'f') THEN {after(dec=f"concat(s.dec, cast(t.cur AS {d.text}))", k="'f'", pend="''")}
      WHEN t.k IN ('u', 't', 'd') AND s.k IN ('u', 't', 'd') AND {small} THEN {after(pre=f"concat(s.pre, cast(s.cur AS {d.text}))", cur="t.cur", k="t.k")}
      WHEN t.k = 'h' AND {hundred} THEN {after(cur="s.cur * 100", k="'h'")}
      WHEN t.k = 's' AND {scaled} THEN {after(tot="s.tot + s.cur * t.cur", cur="cast(0 AS bigint)", cap="t.cur", k="'s'")}
      WHEN t.k = 's' AND {decimal} THEN {after(tot=f"s.cur * t.cur + cast(rpad(s.dec, {places}, '0') AS bigint)", cur="cast(0 AS bigint)", cap="t.cur", dec="''", k="'s'")}
      WHEN t.k = 'a' AND s.k IN ('h', 's') AND s.pend = '' THEN {after(pend="'and'")}
      WHEN t.k = 'p' AND s.k IN ('u', 't', 'd', 'h', 's', 'l') AND s.dec = '' AND s.pend = '' THEN {after(k="'p'", pend="'point'")}
      WHEN t.k = 'c' AND s.k NOT IN ('', 'p') AND s.pend = '' THEN {outside(f"concat(s.out, t.pre, {number}, t.dec, ' ')")}
      WHEN t.k IN ('a', 'p', 'c') THEN {outside(f"concat({ended}, t.out, ' ')")}
      WHEN {ordinal_} IS NOT NULL THEN {outside(f"concat(s.out, s.pre, cast({ordinal_} AS {d.text}), {suffix(f'({ordinal_})')}, ' ')")}
      WHEN t.k LIKE 'o%' THEN {outside(f"concat({ended}, cast(t.cur AS {d.text}), {suffix('t.cur')}, ' ')")}
      ELSE {begun} END"""


def _ended(d: Dialect) -> str:
    """A phrase's text, with the number that it ends in."""
    return f"CASE WHEN s.k = '' THEN s.out ELSE concat(s.out, s.pre, cast(s.tot + s.cur AS {d.text}), CASE WHEN s.dec = '' THEN '' ELSE concat('.', s.dec) END, ' ', s.pend) END"


def _phrase(d: Dialect, phrase: str) -> str:
    """The fold of one phrase."""
    zero = d.struct({"out": "''", "pre": "''", "tot": "cast(0 AS bigint)", "cur": "cast(0 AS bigint)", "cap": "cast(0 AS bigint)", "dec": "''", "k": "''", "pend": "''"})
    folded = d.fold.format(list=d.split.format(c=phrase, of=_word(d)), zero=zero, step=_step(d))
    if d is SPARK:
        return folded[:-1] + f", s -> {_ended(d)})"
    return f"list_transform([{folded}], lambda s: {_ended(d)})[1]"


def numbers(d: Dialect, c: str) -> str:
    """``c``, a text of lower-case words between single spaces, with its number phrases written in digits; ends may have spaces."""
    values = "|".join(word_values())
    starts, goes = f"(?:{values}|{_DIGITS})", f"(?:{values}|{_DIGITS}|and|point|{'|'.join(MARKS)})"
    c = d.replace(c, r"\band a half\b", "point five")
    c = d.replace(c, rf"\ba (hundred|{'|'.join(SCALES)})\b", r"one \1")
    c = d.replace(c, r"\bper cent\b", "percent")
    for word, mark in (("dollars", "$"), ("pounds", "£"), ("euros", "€")):
        c = d.replace(c, rf"[{mark}]({_DIGITS}(?: (?:{'|'.join(SCALES)}))+)\b", rf"\1 {word}")
    apart = f"concat(' ', replace({c}, ' ', '  '), ' ')"  # each word between spaces of its own
    cut = d.replace(apart, f"((?: {starts} )(?: {goes} )*)", "\u0001\\1\u0001")
    pieces = d.each.format(list=d.cut.format(c=cut), odd=_phrase(d, "x"))
    joined = f"array_join({pieces}, ' ')" if d is SPARK else f"array_to_string({pieces}, ' ')"
    joined = d.replace(joined, " +", " ")
    return d.replace(d.replace(joined, r"([$€£][0-9]+) and ¢([0-9])( |$)", r"\1.0\2\3"), r"([$€£][0-9]+) and ¢([0-9][0-9])( |$)", r"\1.\2\3")


def spellings(d: Dialect, c: str) -> str:
    for stems, ending, becomes, more in SPELLINGS:
        c = d.replace(c, rf"\b({stems}){ending}({more})\b", rf"\1{becomes}\2")
    return c


def with_numbers(c: str) -> Column:
    """The column named ``c``, lower-case words between single spaces, with numbers in digits; null stays null. No Python runs."""
    return F.btrim(F.expr(numbers(SPARK, f"`{c}`")))


def with_one_spelling(c: str) -> Column:
    """The column named ``c``, in lower case, with its regional spellings to one form; null stays null."""
    return F.expr(spellings(SPARK, f"`{c}`"))
