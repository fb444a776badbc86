import base64
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import jpeg, queries, urls, warc
from tests.llm.conftest import texts


def test_warc(spark, tmp_path):
    rows = [(1, None, None), (2, "http://a b/\r\n", "x"), (3, None, ""), (None, None, ""), (2, "u", "x"), (5, "é", "x"), (6, "http://b", "y" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha": F.lit(1), "length": F.lit("x"), "first": F.lit(2)})
    out = f"file://{tmp_path}/w"
    index = warc.write(pages, out).collect()
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.read(spark, out).collect())
    assert got == [(0, 0, "response", 0), (1, 0, "response", 0), (2, 1, "response", 0), (2, 1, "response", 0), (3, 0, "revisit", 1), (5, 1, "revisit", 2), (6, 200_000, "response", 0)]
    assert len(index) == len(rows) and all(warc.read_record(f"{out}/{e.file}", e.offset, e.length).startswith(b"WARC/1.1\r\n") for e in index)
    warc.write(pages.limit(0), f"{out}-none")
    assert warc.read(spark, f"{out}-none").count() == 0


def test_pages_equal_plain_ones(spark, tmp_path, monkeypatch):
    """The registered query against hashlib, with a payload that half of the pages have, and archives that are rolled."""
    rows = [(i, f"http://h/{i}", None if i % 10 == 0 else "" if i % 4 == 1 else f"<p>page {i % 50}</p>") for i in range(600)] + [(700, "u", "日本 " * 30_000), (3, "http://again", "<p>page 3</p>"), (None, None, "<p>page 2</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    least = {}
    for i, _, html in rows:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = least.get(html or "")
        refers = first if i is not None and first is not None and i > first else None
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", str(refers)))
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4096)
    got = queries.QUERIES["op1_warc"](spark, str(tmp_path)).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)


def test_archive_has_a_dictionary(spark, tmp_path):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://x").alias("url"), F.concat(F.lit("<html><body class='page'>shared start of every page "), F.col("id"), F.lit("</body></html>")).alias("html")).coalesce(1)
    out = f"file://{tmp_path}/w"
    name = warc.write(pages, out).first().file
    data = (tmp_path / "w" / name).read_bytes()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    assert warc.read(spark, out).count() == 400
    broken = bytearray(data)
    broken[len(data) // 2] ^= 255
    (tmp_path / "w" / name).write_bytes(bytes(broken))
    with pytest.raises(Exception):
        warc.read(spark, out).collect()


def expected_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:end].translate({i: i + 32 for i in range(65, 91)})
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [h + p for _, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_urls(spark):
    values = [None, "", "nope", "http://WWW.Example.COM/en/x?y=1#z", "http://example.com/en/", "http://com", "http://x.com/", "://net/fr/a", "http://a.net/fr/\nb?c", "http://bnet/fr/", "http://www.example.com:80/en/", "a://b?c/d", "http://é.net/es/ñ", "http://example.com/en/" * 2000]
    pages = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(3, values[3]), (None, values[4])], "page_id long, url string").withColumns({"host": F.lit(1), "tokens": F.lit(1), "mined": F.lit(1)})
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    got = urls.filter_urls(pages, labels).collect()
    assert len(got) == len(values) + 2
    kinds = {h + p: k for k, h, p in urls.RULES}
    for r in got:
        host, path, rule = expected_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (kinds[rule] if rule else "allow")
    assert urls.filter_urls(pages.limit(0), labels.limit(0)).count() == 0


def url_tokens(url):
    host, path, _ = expected_rule(url)
    labels = [x for x in host.split(".") if x][::-1]
    found = {"s:" + url.split("://")[0]} if url and "://" in url else set()
    found |= {"d:" + ".".join(labels[:2][::-1])} if labels else set()
    found |= {f"l{i}:{x}" for i, x in enumerate(labels[2:])} | {"p:" + x for x in path.split("/") if x and not re.search("[0-9]", x)}
    query = re.search(r"(?s)\?([^#]*)", url or "")
    return found | {"q:" + x.split("=")[0] for x in (query[1].split("&") if query else []) if x}


def plain_rules(rows):
    """All token sets of up to three tokens of ``rows`` [(tokens, verdict)], counted one by one."""
    n, share = len(rows), {v: sum(x == v for _, x in rows) / len(rows) for v in urls.LIFT}
    least = max(urls.SUPPORT, urls.LEAST / n) * n
    sets = {frozenset(c) for t, _ in rows for k in (1, 2, 3) for c in itertools.combinations(sorted(t), k)}
    out = []
    for s in sets:
        held = [v for t, v in rows if s <= t]
        for v, base in share.items():
            hits = held.count(v)
            c = hits / len(held)
            if hits >= least - 1e-9 and c > urls.CONFIDENCE and c >= urls.LIFT[v] * base:
                out.append((sorted(s), v, c, hits / n, (c - base) / math.sqrt(base * (1 - base) / len(held)) if base < 1 else 0.0))
    kept = []
    for r in sorted(out, key=lambda r: (len(r[0]), -r[2], r[0])):
        if not any(k[1] == r[1] and k[2] >= r[2] and set(k[0]) <= set(r[0]) for k in kept):
            kept.append(r)
    return sorted(kept, key=lambda r: (-round(r[4], 9), -r[2], -r[3], r[1] != "block", r[0])), "block" if share["block"] > share["allow"] else "allow"


def test_verdicts_equal_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(['www.', 'm.', ''])}{rng.choice(['spam', 'fine', 'calm', 'dull'])}.example.{rng.choice(['org', 'io'])}/{rng.choice(['en', 'de'])}/{i}{rng.choice(['', '?ref=1', '?p=2&q=3', '#x'])}") for i in range(400)]
    rows += [(900, None), (901, ""), (902, "nope"), rows[3], (903, "http://example.com/en/7"), (904, rows[5][1])]
    bad = {i: int(rng.random() < (0.8 if "spam" in u else 0.3 if "/de/" in u else 0.05)) for i, u in rows if i < 300 and i % 7}
    labels = [(i, int(not b or i % 2), int(b and i % 2)) for i, b in bad.items()] + [(5, 1, 0), (None, 0, 1), (6, None, None)]
    for i, _, t in labels[-3:]:
        if i is not None:
            bad[i] = max(bad.get(i, 0), int(t or 0))
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    known = []
    for url in {u for _, u in rows if u}:
        number = re.search(r"([0-9]+)[^0-9/]*/?$", expected_rule(url)[1])
        if number and int(number[1]) in bad:
            known.append((url_tokens(url), "block" if bad[int(number[1])] else "allow"))
    want, usual = plain_rules(known)
    assert {r[1] for r in want} == {"block", "allow"}
    got = queries.QUERIES["op9_url_filters"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    kinds = {h + p: k for k, h, p in urls.RULES}
    for r in got:
        url = next(u for i, u in rows if i == r.page_id)
        host, path, rule = expected_rule(url)
        mined = None if rule else next((x for x in want if set(x[0]) <= url_tokens(url)), None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (kinds[rule] if rule else mined[1] if mined else usual)
        assert (r.mined_rule, r.confidence, r.support) == ((" & ".join(mined[0]), pytest.approx(mined[2]), pytest.approx(mined[3])) if mined else (None, None, None))
    tried = {(r.mined, r.label): r.n for r in urls.assess(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert tried["block", "block"] > tried.get(("block", "allow"), 0)


def test_labels_are_met_without_copies_of_them(spark):
    """Most URLs end in one number; the labels' table may be large, so it is neither multiplied nor sent to all."""
    rows = [(f"http://a.org/{7 if i % 3 else i}?n={i}", "a.org", f"/{7 if i % 3 else i}") for i in range(3000)]
    labels = [(i, int(i % 5 > 0), int(i == 7)) for i in range(2000)]
    found = urls.labelled_urls(spark.createDataFrame(rows, "url string, host string, path string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    bad = {i: q == 0 or t == 1 for i, q, t in labels}
    want = [(*r, "block" if bad[int(r[2][1:])] else "allow") for r in rows if int(r[2][1:]) in bad]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_shared_parameters_are_mined_as_one(spark):
    """Two hundred URLs with forty parameters each: every set of these has the same URLs."""
    rng = random.Random(8)
    campaign = [f"q:p{k}" for k in range(40)]
    rows = [(sorted({f"d:{rng.choice('abc')}.org", f"p:{rng.choice('xy')}", *(campaign if i % 2 else [])}), "block" if i % 2 and rng.random() < 0.8 else "allow") for i in range(200)]
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    begun = time.time()
    rules, usual = urls.mine(df)
    assert time.time() - begun < 60
    short = [([t for t in tokens if not t.startswith("q:p") or t in ("q:p0", "q:p1")], v) for tokens, v in rows]
    want, other = plain_rules([(set(t), v) for t, v in short])
    got = [r for r in rules if not any(t.startswith("q:p") and t not in ("q:p0", "q:p1") for t in r.tokens)]
    assert usual == other and [(r.tokens, r.verdict) for r in got] == [(r[0], r[1]) for r in want]
    assert sum(len(r.tokens) == 1 and r.tokens[0].startswith("q:p") for r in rules) == 40


def test_ties_of_verdicts_and_rules(spark):
    rows = [(["a", "b"], "block")] * 8 + [(["a", "c"], "allow")] * 8
    rules, usual = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    assert usual == "allow" and [(r.tokens, r.verdict) for r in rules] == [(["b"], "block"), (["c"], "allow")]
    both = urls.matched(spark.createDataFrame([(["c", "b"],), ([],), (["a"],)], "tokens array<string>"), rules).collect()
    assert [r["_mined"] and r["_mined"].verdict for r in both] == ["block", None, None]


def test_mined_rules_block_their_hosts(spark):
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'fine'}.example.org/p/{i}?ref=1") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = urls.filter_urls(pages, labels).collect()
    assert all((r.verdict == "block") == (r.page_id % 3 == 0) for r in got)


def slow_rgb(image):
    """An independent reading of the image that ``store_bytes`` writes: samples by the cosine sum of each coefficient, one at a time."""
    head, arrays = jpeg.coefficients(image)
    high, wide = head["size"]
    cosines = [[math.cos((2 * x + 1) * k * math.pi / 16) * (math.sqrt(0.125) if k == 0 else 0.5) for k in range(8)] for x in range(8)]
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    out = np.zeros((high, wide, 3))
    planes = []
    for c, (_, h, v, _) in zip(arrays, head["parts"]):
        plane = np.zeros((c.shape[0] * 8, c.shape[1] * 8))
        for r in range(c.shape[0]):
            for q in range(c.shape[1]):
                for y in range(8):
                    for x in range(8):
                        plane[8 * r + y, 8 * q + x] = sum(int(c[r, q, z]) * cosines[y][order[z] // 8] * cosines[x][order[z] % 8] for z in range(64))
        planes.append(np.rint(plane + 128).clip(0, 255))
    for y in range(high):
        for x in range(wide):
            lum, cb, cr = planes[0][y, x], planes[1][y // 2, x // 2] - 128, planes[2][y // 2, x // 2] - 128
            out[y, x] = lum + 1.402 * cr, lum - 0.344136 * cb - 0.714136 * cr, lum + 1.772 * cb
    return np.rint(out).clip(0, 255)


def test_jpeg_round_trip(spark, documents, no_documents, tmp_path):
    documents.withColumn("media", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op10_progressive_jpeg"](spark, str(tmp_path)).collect()
    assert len(got) == len(texts())
    by_text = {}
    for r in got:
        if r.doc_id is None:
            continue
        raw = (next(t for i, t, *_ in texts() if i == r.doc_id) or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        image = jpeg.store_bytes(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        assert by_text.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
        rgb = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        size, sums, bits = r.feature.split(":")
        assert size == f"{r.height}x{r.width}" and sums == ",".join(str(int(rgb[:, :, k].astype(int).sum())) for k in range(3))
        fields = [[rgb[h * r.height // 8 : (h + 1) * r.height // 8, w * r.width // 8 : (w + 1) * r.width // 8].astype(int).sum(axis=2).mean() for w in range(8)] for h in range(8)]
        assert bits == "".join(f"{int(''.join('01'[int(x > np.mean(fields))] for x in row), 2):02x}" for row in fields)
        if len(raw) < 200:
            # rounding of the planes may differ where a sample lies between two numbers
            assert np.mean(np.abs(rgb - slow_rgb(image)) > 2) < 0.001
    assert jpeg.unpack(jpeg.to_media(no_documents)).count() == 0
    empty = jpeg.unpack(jpeg.to_media(documents).select("doc_id", "n_bytes", F.lit(None).cast("binary").alias("media"))).collect()
    assert len(empty) == len(texts()) and all(r.payload_sha256 is None and r.rgb is None for r in empty)


class Encoder:
    """A slow progressive encoder of any coefficients, with restart intervals, for the decoder's general path."""

    def __init__(self, arrays, units, parts, size, interval=0):
        self.arrays, self.units, self.parts, self.size, self.interval = arrays, units, parts, size, interval
        body, self.dc = jpeg.huffman_table({n: 4 for n in range(12)})
        ac_body, self.ac = jpeg.huffman_table({(r << 4 | s): 8 for r in range(16) for s in range(1, 11)} | {r << 4: 7 for r in range(16)})
        high, wide = size
        self.out = b"\xff\xd8" + jpeg._segment(jpeg.DQT, b"\0" + bytes(range(1, 65)))
        self.out += jpeg._segment(jpeg.SOF2, bytes([8]) + high.to_bytes(2, "big") + wide.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([c, h << 4 | v, q]) for c, h, v, q in parts))
        self.out += jpeg._segment(jpeg.DHT, b"\0" + body + b"\x10" + ac_body)
        if interval:
            self.out += jpeg._segment(jpeg.DRI, interval.to_bytes(2, "big"))

    def put(self, code, n):
        self.bits += [code >> (n - 1 - i) & 1 for i in range(n)]

    def scan(self, chosen, first, last, high, low):
        self.out += jpeg._segment(jpeg.SOS, bytes([len(chosen)]) + b"".join(bytes([self.parts[i][0], 0]) for i in chosen) + bytes([first, last, high << 4 | low]))
        down, across = self.units
        if first == 0:
            units = [[(i, (u // across * self.parts[i][2] + y) * across * self.parts[i][1] + u % across * self.parts[i][1] + x) for i in chosen for y in range(self.parts[i][2]) for x in range(self.parts[i][1])] for u in range(down * across)]
        else:
            i = chosen[0]
            most = [max(p[k] for p in self.parts) for k in (1, 2)]
            rows, columns = -(-(-(-self.size[0] * self.parts[i][2] // most[1])) // 8), -(-(-(-self.size[1] * self.parts[i][1] // most[0])) // 8)
            units = [[(i, r * across * self.parts[i][1] + c)] for r in range(rows) for c in range(columns)]
        step = self.interval or len(units)
        for k in range(0, len(units), step):
            self.bits = []
            last_dc = {i: 0 for i in chosen}
            for unit in units[k : k + step]:
                for i, b in unit:
                    block = self.arrays[i].reshape(-1, 64)[b].tolist()
                    if first == 0:
                        self.dc_block(block, i, last_dc, high, low)
                    elif high == 0:
                        self.ac_block(block, first, last, low)
                    else:
                        self.refine_block(block, first, last, low)
            self.out += jpeg._stuffed(np.array(self.bits, np.uint8))
            if k + step < len(units):
                self.out += bytes([0xFF, 0xD0 + k // step % 8])

    def value(self, v, size):
        self.put(v if v >= 0 else v + (1 << size) - 1, size)

    def dc_block(self, block, i, last_dc, high, low):
        v = block[0] >> low
        if high:
            return self.put(v & 1, 1)
        d, last_dc[i] = v - last_dc[i], v
        size = abs(d).bit_length()
        self.put(*self.dc[size])
        self.value(d, size)

    def ac_block(self, block, first, last, low):
        run = 0
        for k in range(first, last + 1):
            v = int(np.sign(block[k])) * (abs(block[k]) >> low)
            if v == 0:
                run += 1
                continue
            while run > 15:
                self.put(*self.ac[0xF0])
                run -= 16
            size = abs(v).bit_length()
            self.put(*self.ac[run << 4 | size])
            self.value(v, size)
            run = 0
        if run:
            self.put(*self.ac[0])

    def refine_block(self, block, first, last, low):
        run, pending = 0, []
        end = max([k for k in range(first, last + 1) if abs(block[k]) >> low == 1], default=first - 1)
        for k in range(first, last + 1):
            v = abs(block[k]) >> low
            if v == 0:
                run += 1
                continue
            while run > 15 and k <= end:
                self.put(*self.ac[0xF0])
                self.bits += pending
                pending, run = [], run - 16
            if v > 1:
                pending.append(int(v & 1))
                continue
            self.put(*self.ac[run << 4 | 1])
            self.put(int(block[k] > 0), 1)
            self.bits += pending
            pending, run = [], 0
        if run or pending:
            self.put(*self.ac[0])
            self.bits += pending

    def image(self):
        return self.out + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 3])
@pytest.mark.parametrize("gray", [False, True])
def test_decoder_reads_any_coefficients(interval, gray):
    rng = np.random.default_rng(8)
    parts = [(1, 1, 1, 0)] if gray else [(1, 2, 2, 0), (2, 1, 1, 0), (3, 1, 1, 0)]
    size, units = ((40, 72), (5, 9)) if gray else ((40, 72), (3, 5))
    arrays = []
    for k, (_, h, v, _) in enumerate(parts):
        c = rng.integers(-60, 61, (units[0] * v, units[1] * h, 64)) * (rng.random((units[0] * v, units[1] * h, 64)) < 0.15)
        rows, columns = -(-size[0] // 8) if k == 0 else units[0], -(-size[1] // 8) if k == 0 else units[1]
        c[rows:, :, 1:] = 0
        c[:, columns:, 1:] = 0
        arrays.append(c)
    e = Encoder(arrays, units, parts, size, interval)
    every = list(range(len(parts)))
    e.scan(every, 0, 0, 0, 1)
    for i in every:
        e.scan([i], 1, 5, 0, 2)
        e.scan([i], 6, 63, 0, 2)
        e.scan([i], 1, 63, 2, 1)
    e.scan(every, 0, 0, 1, 0)
    for i in every:
        e.scan([i], 1, 63, 1, 0)
    head, got, rgb = jpeg.decode(e.image())
    for want, have in zip(arrays, got):
        assert np.array_equal(want, have)
    assert rgb.shape == (*size, 3) and rgb.dtype == np.uint8
    flat = jpeg.render({**head}, [np.zeros_like(a) for a in got])
    assert (flat == 128).all()


def test_inverse_transform_is_that_of_the_cosines():
    block = np.zeros(64, np.float32)
    block[0] = 80
    assert np.allclose(block @ jpeg.inverse_transform(), 10)
    m = jpeg.inverse_transform().astype(float)
    assert np.allclose(m @ m.T, np.eye(64), atol=1e-5)
    assert jpeg.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
