import hashlib
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from lodestone.llm import gif, langid

from .helpers import ODD, documents


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 5000, bytes(range(256)) * 300, np.random.default_rng(1).integers(0, 256, 40000, dtype=np.uint8).tobytes()])
def test_lzw_round_trip(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_full_table_without_clear_is_read():
    # an encoder that never clears: codes stay 12 bits wide once the table is full
    data = np.random.default_rng(3).integers(0, 256, 9000, dtype=np.uint8).tobytes()
    table, nxt, codes, w = {}, 258, [256], data[0]
    for b in data[1:]:
        if (w, b) in table:
            w = table[w, b]
        else:
            codes.append(w)
            if nxt < 4096:
                table[w, b] = nxt
                nxt += 1
            w = b
    codes += [w, 257]
    bits, width, seen = [], 9, 257
    for c in codes:
        bits += [(c >> k) & 1 for k in range(width)]
        if c != 256:
            seen += 1
            if seen >= 1 << width and width < 12:
                width += 1
    raw = np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()
    assert gif.lzw_decode(raw, 8, len(data)) == data


def test_transparency_disposal_and_palettes():
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    a, b = np.zeros((4, 4), np.uint8), np.full((2, 2), 3, np.uint8)
    b[0, 0] = 1
    media = gif.encode([a, b, np.full((1, 1), 2, np.uint8)], palette, [50, 100, 20], disposal=3, transparent=3)
    frames = gif.decode(media)
    assert [f.delay_ms for f in frames] == [50, 100, 20]
    assert frames[0].rgb[0, 0].tolist() == [255, 0, 0]
    assert frames[1].rgb[0, 0].tolist() == [0, 255, 0] and not frames[1].alpha[1, 1]
    assert frames[2].rgb[0, 0].tolist() == [0, 0, 255] and not frames[2].alpha[3, 3]
    kept = gif.decode(gif.encode([a, b], palette, disposal=1, transparent=3))
    assert kept[1].rgb[1, 1].tolist() == [255, 0, 0] and kept[1].alpha.all()
    for cut_at in (3, 20, len(media) - 5):
        with pytest.raises(gif.GifError):
            gif.decode(media[:cut_at])


def plain_decoder(data):
    """(canvas colours by frame, delays in ms), code by code and pixel by pixel; what it doesn't know fails."""
    assert data[:6] == b"GIF89a"
    width, height, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    n = 2 << (flags & 7)
    palette = [tuple(data[13 + 3 * i : 16 + 3 * i]) for i in range(n)]
    at = 13 + 3 * n
    canvas, shown, delays, delay, clear_index = {}, [], [], 0, None

    def blocks(at):
        out = b""
        while data[at]:
            out += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        return out, at + 1

    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9:
                assert body[0] >> 2 & 7 in (0, 1)
                delay, clear_index = 10 * int.from_bytes(body[1:3], "little"), body[3] if body[0] & 1 else None
            continue
        left, top, w, h = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
        assert data[at] == 0x2C and data[at + 9] == 0
        low = data[at + 10]
        stream, at = blocks(at + 11)
        bits, pos, size, table, prev, out = int.from_bytes(stream, "little"), 0, low + 1, None, None, []
        while True:
            code, pos = bits >> pos & (1 << size) - 1, pos + size
            if code == 1 << low:
                table, size, prev = [[i] for i in range(1 << low)] + [None, None], low + 1, None
                continue
            if code == (1 << low) + 1:
                break
            entry = table[code] if code < len(table) else [*prev, prev[0]]
            if prev is not None and len(table) < 4096:
                table.append([*prev, entry[0]])
            if len(table) == 1 << size and size < 12:
                size += 1
            out += entry
            prev = entry
        assert len(out) == w * h
        for k, i in enumerate(out):
            if i != clear_index:
                canvas[top + k // w, left + k % w] = palette[i]
        shown.append([canvas[top + k // w, left + k % w] for k in range(w * h)])
        delays.append(delay)
    assert all(y < height and x < width for y, x in canvas)
    return shown, delays


@pytest.mark.parametrize("payload", [b"\0" * 64, bytes(range(256)) * 3, b"the same line of 64 characters, again and again, and once more!\n" * 60, bytes(range(250)) * 64])
def test_another_decoder_reads_what_is_stored(payload):
    media = gif.pack(payload, rows=20)
    shown, delays = plain_decoder(media)
    colour = {tuple(c): i for i, c in enumerate(gif.COLOURS.tolist())}
    assert len(colour) == 256
    assert bytes(colour[c] for f in shown for c in f) == payload == gif.unpack(media)[0]
    assert delays == [100] * len(shown) == [f.delay_ms for f in gif.unpack(media)[1]]
    for f, own in zip(shown, gif.unpack(media)[1], strict=True):
        want = np.zeros(64, int)
        for r, g, b in f:
            want[r // 64 * 16 + g // 64 * 4 + b // 64] += 1
        assert gif.histogram(own).tolist() == want.tolist()


def test_histograms_tell_colours_of_one_luminance():
    palette = bytes([255, 0, 0, 0, 130, 0, 0, 0, 0, 0, 0, 0])
    red, green = (gif.decode(gif.encode([np.full((4, 4), i, np.uint8)], palette))[0] for i in (0, 1))
    assert gif.histogram(red).tolist() != gif.histogram(green).tolist()


def test_repeated_frames_are_transparent():
    line = b"the same line of 64 characters, again and again, and once more!\n"
    media = gif.pack(line * 3000)
    assert any(f.transparent == gif.CLEAR and (f.indices == gif.CLEAR).all() for f in gif.parse(media)[3])
    assert gif.unpack(media)[0] == line * 3000


def test_decoding_is_linear():
    data = np.random.default_rng(1).integers(0, 256, 1 << 21, dtype=np.uint8).tobytes()
    stream = gif.lzw_encode(data)
    took = time.process_time()
    assert gif.lzw_decode(stream, 8, len(data)) == data
    assert time.process_time() - took < 10  # a quadratic reading takes minutes


def test_query_digests_what_is_stored(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in gif.QUERY["op4_gif_media"](spark, sf).collect():
        raw = docs[r.doc_id].encode()
        media = gif.pack(gif.payload_of(raw))
        assert (r.n_bytes, r.payload_bytes, r.media_bytes, r.media_sha256) == (len(raw), len(gif.payload_of(raw)), len(media), hashlib.sha256(media).hexdigest())
        bins = np.zeros(64, int)
        for v in gif.payload_of(raw):
            bins[(v >> 6) * 16 + (v >> 3 & 3) * 4 + (v & 3)] += 1
        assert r.feature == f"frames={-(-len(gif.payload_of(raw)) // 65536)};ms={100 * -(-len(gif.payload_of(raw)) // 65536)};rgb=" + ",".join(map(str, bins))


def test_digests(spark):
    got = gif.media_digests(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    want = {}
    for i, t in ODD:
        raw = (t or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 or (64 if not raw else 0))
        want.setdefault(i, set()).add((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id]
    assert gif.media_digests(documents(spark, [])).count() == 0


def test_columns_and_frames(spark):
    media = gif.encode_column(documents(spark, [(1, "abc" * 50000), (2, None)]), "text")
    frames = gif.explode_frames(media, "doc_id", "media").orderBy("frame").collect()
    assert [f.start_ms for f in frames] == [100 * k for k in range(len(frames))] and len(frames) == 3
    assert sum(sum(f.histogram) for f in frames) == len(gif.payload_of(b"abc" * 50000))
    bad = gif.explode_frames(spark.createDataFrame([(1, bytearray(b"no gif"))], "i long, m binary"), "i", "m").collect()
    assert bad[0].error and bad[0].frame is None


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 40 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_language_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs, langid.F.lit(True))
    got = langid.predict(documents(spark, ODD), model).collect()
    assert len(got) == len(ODD)
    for r in got:
        none = r.doc_id in (1, 2, 3, 10)
        assert (r.lang_pred == "und") >= none
        if none:
            assert r.rejected and r.score == 0
    empty = langid.train(documents(spark, []), langid.F.lit(True))
    assert {r.lang_pred for r in langid.predict(documents(spark, ODD), empty).collect()} == {"und"}
    assert langid.predict(documents(spark, []), model).count() == 0


def test_rejection_is_calibrated(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.predict(docs, langid.train(docs, langid.F.lit(True))).collect()
    assert sum(r.rejected for r in got) <= 0.02 * len(got)


def test_keep_identified_without_labels_or_ids(spark):
    texts = [(f"the cat and the dog number {i} went over there", "en") for i in range(12)] + [(f"der Hund und die Katze Nummer {i} gingen dorthin", "de") for i in range(12)]
    unlabelled = documents(spark, [*[(i, t, None) for i, (t, _) in enumerate(texts)], (90, "1 2 3", None), (91, None, None)])
    kept = langid.keep_identified(unlabelled, langid.train(unlabelled, langid.F.lit(True))).collect()
    assert sorted(r.doc_id for r in kept) == list(range(24))
    nameless = documents(spark, [*[(None, t, lang) for t, lang in texts], (None, "4 5 6", None)])
    model = langid.train(nameless, langid.F.lit(True))
    assert sorted(model.langs) == ["de", "en"]
    assert {r.lang for r in langid.keep_identified(nameless, model).collect()} == {"de", "en"}


def brute_features(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    counts = np.zeros(4096)
    for k in (1, 2, 3, 4):
        for i in range(len(raw) - k + 1):
            code = raw[i] + 977 * k
            for c in raw[i + 1 : i + k]:
                code = (code * 0x01000193 + c) % 2**32
            counts[code * 0x9E3779B1 % 2**32 >> 20] += 1
    return counts / max(1, counts.sum())


def test_features_against_brute_force():
    texts = ["", "a", "AbC", "Łódź und Köln", "the cat " * 9, "字", "x" * 300]
    joined = [t.encode() for t in texts]
    got = langid.features(np.frombuffer(b"".join(joined), np.uint8), np.concatenate([[0], np.cumsum([len(j) for j in joined])]))
    assert np.allclose(got, [brute_features(t) for t in texts], atol=1e-6)


def brute_fit(x, labels, dim, steps, batch, rate, seed):
    """One example at a time, in double precision: embeddings averaged by shares, a softmax over them, plain SGD."""
    langs = sorted(set(labels))
    y = [langs.index(v) for v in labels]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 4], order[len(y) // 4 :]
    scale = np.minimum(1 / np.sqrt(np.maximum((x[train] ** 2).mean(0), 1e-9)), 1000) / 64
    e, w, b = rng.normal(0, 0.1, (4096, dim)), np.zeros((dim, len(langs))), np.zeros(len(langs))
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    epochs = max(1, steps * batch // len(train))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.01
        rng.shuffle(train)
        for i in range(0, len(train), batch):
            some = train[i : i + batch]
            de, dw, db = np.zeros_like(e), np.zeros_like(w), np.zeros_like(b)
            for r in some:
                v = x[r] * scale
                h = v @ e
                g = softmax(h @ w + b)
                g[y[r]] -= 1
                dw += np.outer(h, g) / len(some)
                db += g / len(some)
                de += np.outer(v, w @ g) / len(some)
            e, w, b = e - step * de, w - step * dw, b - step * db
    z = [(x[r] * scale) @ e @ w + b for r in held]
    loss = lambda t: np.mean([-np.log(softmax(v / t)[y[r]]) for v, r in zip(z, held, strict=True)])
    t = min(np.geomspace(0.5, 8, 33), key=loss)
    best = [softmax(v / t) for v in z]
    right = [p.max() for p, r in zip(best, held, strict=True) if p.argmax() == y[r]]
    return scale[:, None] * (e @ w), b, t, min(0.5, np.quantile(right, 0.001) * 0.9)


def test_training_against_brute_force():
    rng = np.random.default_rng(0)
    words = {"en": ["the", "and", "over", "dog", "house"], "de": ["der", "und", "ueber", "hund", "haus"], "fr": ["le", "et", "sur", "chien", "maison"]}
    labels = [lang for _ in range(20) for lang in words]
    x = np.array([brute_features(" ".join(rng.choice(words[v], 12))) for v in labels], np.float32)
    model = langid.fit(x, labels, dim=4, steps=12, batch=16, rate=0.5, seed=3)
    weights, bias, temperature, threshold = brute_fit(x.astype(float), labels, 4, 12, 16, 0.5, 3)
    assert model.langs == ["de", "en", "fr"]
    assert np.allclose(model.weights, weights, atol=1e-3 * np.abs(weights).max()) and np.allclose(model.bias, bias, atol=1e-3)
    assert model.temperature == pytest.approx(temperature) and model.threshold == pytest.approx(threshold, abs=1e-3)
    z = (x @ weights + bias) / temperature
    p = np.exp(z - z.max(1, keepdims=True))
    best, score = model.scores(x)
    assert (best == p.argmax(1)).all() and np.allclose(score, (p / p.sum(1, keepdims=True)).max(1), atol=1e-3)


def test_fit_holds_its_sample_once():
    rng = np.random.default_rng(2)
    labels = [f"l{k % 3}" for k in range(langid.SAMPLE)]
    x = np.zeros((len(labels), langid.BUCKETS), np.float32)
    for k in range(len(labels)):
        x[k, rng.integers(k % 3 * 900, 2000 + k % 3 * 900, 60)] = 1 / 60
    tracemalloc.start()
    model = langid.fit(x, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.accuracy > 0.9 and peak < x.nbytes
