"""The number transducer against a plain one, written from its docstring, on phrases made at random."""

import random

import duckdb

from frameloom.functions import spoken, text

VALUES = spoken.word_values()


class Plain:
    def __init__(self):
        self.out, self.reset = [], lambda: self.__dict__.update(pre="", groups=0, scale=None, group=0, decimals="", last="", waits="")
        self.reset()

    def end(self, mark="", after=""):
        if self.last:
            self.out.append(mark + self.pre + str(self.groups + self.group) + ("." + self.decimals if self.decimals else "") + after)
            if self.waits:
                self.out.append(self.waits)
        self.reset()

    def begin(self, kind, value, pre="", decimals=""):
        self.end()
        self.pre, self.last, self.decimals = pre, kind, decimals
        if kind == "s":
            self.groups, self.scale = value, value
        else:
            self.group = value

    def may_be_hundreds(self):
        return self.last in ("u", "t", "d", "l") and not self.pre and 0 < self.group < 100

    def may_scale(self, value):
        whole = not self.decimals and self.last in ("u", "t", "d", "h", "l") and not self.waits
        return whole and not self.pre and 0 < self.group < 10**6 and (self.scale is None or value < self.scale)

    def read(self, word):
        kind, value = VALUES.get(word, (None, None))
        if word == "and" or word == "point":
            if word == "and" and self.last in ("h", "s") and not self.waits:
                self.waits = "and"
            elif word == "point" and self.last in ("u", "t", "d", "h", "s", "l") and not self.decimals and not self.waits:
                self.last, self.waits = "p", "point"
            else:
                self.end()
                self.out.append(word)
        elif word in spoken.MARKS:
            if self.last and self.last != "p" and not self.waits:
                self.end(*(("", "%") if word == "percent" else (spoken.MARKS[word], "")))
            else:
                self.end()
                self.out.append(word)
        elif kind is None:
            whole, _, decimals = word.partition(".")
            self.begin("m" if decimals else "l", int(whole), "0" * (len(whole) - len(whole.lstrip("0") or "0")), decimals)
        elif kind in ("u", "t", "d"):
            joins = self.last in ("h", "s") or (kind == "u" and self.last == "d")
            if joins and not (kind == "u" and value == 0):
                self.group, self.last, self.waits = self.group + value, kind, ""
            elif kind == "u" and self.last in ("p", "f"):
                self.decimals, self.last, self.waits = self.decimals + str(value), "f", ""
            elif self.last in ("u", "t", "d") and self.groups == 0 and self.group < 100:
                self.pre, self.group, self.last = self.pre + str(self.group), value, kind
            else:
                self.begin(kind, value)
        elif kind == "h":
            if self.may_be_hundreds():
                self.group, self.last = 100 * self.group, "h"
            else:
                self.begin("h", 100)
        elif kind == "s":
            zeros = len(str(value)) - 1
            if self.may_scale(value):
                self.groups, self.group, self.scale, self.last = self.groups + self.group * value, 0, value, "s"
            elif self.last in ("f", "m") and not self.pre and not self.groups and self.group < 10**6 and len(self.decimals) <= zeros:
                self.groups, self.group, self.scale, self.last = self.group * value + int(self.decimals.ljust(zeros, "0")), 0, value, "s"
                self.decimals = ""
            else:
                self.begin("s", value)
        else:
            n = None
            if (kind == "ou" and self.last in ("d", "h", "s")) or (kind in ("ot", "od") and self.last in ("h", "s")):
                n = self.groups + self.group + value
            elif kind == "oh" and self.may_be_hundreds():
                n = self.groups + self.group * 100
            elif kind == "os" and self.may_scale(value):
                n = self.groups + self.group * value
            if n is None:
                self.end()
                pre, n = "", value
            else:
                pre = self.pre
                self.reset()
            self.out.append(pre + str(n) + ("th" if n % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")))


def plain(phrase):
    import re

    at = Plain()
    phrase = re.sub(rf"\ba (hundred|{'|'.join(spoken.SCALES)})\b", r"one \1", phrase.replace("and a half", "point five"))
    going = False
    for w in phrase.split():
        starts = w in VALUES or re.fullmatch(r"[0-9]{1,15}(\.[0-9]{1,9})?", w)
        if starts or (going and (w in ("and", "point") or w in spoken.MARKS)):
            going = True
            at.read(w)
        else:
            going = False
            at.end()
            at.out.append(w)
    at.end()
    text = re.sub(r"([$€£][0-9]+) and ¢([0-9])( |$)", r"\1.0\2\3", " ".join(at.out))
    return re.sub(r"([$€£][0-9]+) and ¢([0-9][0-9])( |$)", r"\1.\2\3", text)


def phrases(n=600):
    rng = random.Random(11)
    words = [w for w in VALUES if not VALUES[w][0].startswith("o")]
    more = [*spoken.MARKS, "and", "and", "point", "point", "12", "3.5", "007", "0.25", "2500000", "house", "and a half", "a hundred", *(w for w in VALUES if VALUES[w][0].startswith("o"))]
    return [" ".join(rng.choice(words if rng.random() < 0.75 else more) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_transducer_equals_a_plain_one(spark):
    rows = phrases()
    df = spark.createDataFrame(list(enumerate(rows)), "i int, v string").repartition(3)
    found = df.select("i", spoken.with_numbers("v").alias("o"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = [r["o"] for r in found.orderBy("i").collect()]
    want = [plain(p) for p in rows]
    assert [(p, g, w) for p, g, w in zip(rows, got, want) if g != w] == []
    sql = spoken.numbers(spoken.DUCKDB, "v")
    assert [r[0] for r in duckdb.connect().execute(f"SELECT trim({sql}) FROM (SELECT unnest(?) AS v)", [rows]).fetchall()] == want


def test_numbers_by_hand(spark):
    cases = {
        "twenty one": "21", "one hundred and one people": "101 people", "nineteen eighty four": "1984", "one two three": "123", "two and a half million": "2500000",
        "one hundred third place": "103rd place", "five dollars and seven cents": "$5.07", "$2.5 million": "$2500000", "fifteen hundred": "1500", "one thousand and": "1000 and",
        "the point is": "the point is", "two thousand million": "2000 1000000", "zero seven": "07", "a hundred and fifty pounds": "£150", "ten per cent": "10%", "eleventh twenty second": "11th 22nd",
        "": "", "no numbers": "no numbers",
    }
    df = spark.createDataFrame([*((k,) for k in cases), (None,)], "v string")
    assert [r[0] for r in df.select(spoken.with_numbers("v")).collect()] == [*cases.values(), None]


def test_long_texts_take_linear_time(spark):
    many = " ".join(["word", "twenty one", "thousand", "and"] * 30_000)
    assert spark.createDataFrame([(many,)], "v string").select(spoken.with_numbers("v")).first()[0] == " ".join(["word 21000 and"] * 30_000)


def test_spellings(spark):
    pairs = {
        "colour": "color", "favourites": "favorites", "organisation": "organization", "realised": "realized", "analysing": "analyzing", "theatres": "theaters", "travelled": "traveled", "defence": "defense",
        "licences": "licenses", "catalogues": "catalogs", "grey": "gray", "mouldy": "moldy", "programme": "program", "practising": "practicing", "sceptical": "skeptical", "tyres": "tires",
        "cheques": "checks", "jewellery": "jewelry", "fulfilment": "fulfillment", "four": "four", "wise": "wise", "our": "our", "metric": "metric", "level": "level", "honour-bound": "honor-bound",
    }
    df = spark.createDataFrame([(k,) for k in pairs], "v string")
    assert [r[0] for r in df.select(spoken.with_one_spelling("v")).collect()] == list(pairs.values())


def test_error_rates_don_t_see_the_way_numbers_are_written(spark):
    rows = [("Mr. Brown's twenty-first, on the forty-second of the programme: five thousand dollars", "mister brown's 21st on the 42nd of the program $5,000")]
    df = spark.createDataFrame(rows, "a string, b string").select(text.normalized_english("a").alias("a"), text.normalized_english("b").alias("b"))
    assert df.first().a == df.first().b
