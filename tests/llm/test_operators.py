"""The operators on awkward rows, against plain models."""

import hashlib
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import bpe, fingerprint, graph, langid, licenses, neighbours, packing, pitman_yor, secrets, simhash, substrings
from tests.llm.cases import DE, EN, SCHEMA, prose, rows, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def words(text):
    return (text or "").encode().split()


ODD = [
    "", " ", "  two  spaces ", "a\n\n b\tc \r\n", "it's we'll I'D", "x" * 300, "ab" * 500 + "é", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>",
    "日本語テキスト ｶﾅ", "՘x ࢏y Ᲊ", "é ‍\U0001f469‍\U0001f680", "tab\there nbsp em", "12 345,678.90 — «q»", "\x00\x1f\x85",
]


@pytest.mark.parametrize("text", ODD)
def test_encoder_equals_the_library(library, text):
    tool = bpe.codec(PATH)
    ids = np.frombuffer(tool.encode(text), "<u4").astype(np.int64)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert tool.decode(ids).decode() == text


def test_round_trip_and_columns(docs, library):
    found = Counter(map(tuple, bpe.round_trip(docs, PATH).collect()))
    expected = Counter()
    for doc, text, *_ in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected[doc, len(ids), digest(",".join(map(str, ids))), digest(text or "")] += 1
    assert found == expected
    encoded = bpe.encode(docs, PATH)
    assert Counter(r.text for r in bpe.decode(encoded, PATH).collect()) == Counter(r[1] or "" for r in rows())


def test_language(spark, docs):
    samples = langid.learn(docs)
    assert [k for k, _ in samples.texts] == ["de", "en"]
    found = langid.predict(docs, samples).select("doc_id", "text", "lang_pred", "score").collect()
    for r in found:
        assert 0 <= r.score <= 1
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
    held = [(i, prose(EN if i % 2 else DE, 12, 100 + i), None, None, None) for i in range(40)]
    judged = langid.predict(table(spark, held), samples).select("doc_id", "lang_pred").collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in judged)
    nothing = langid.predict(docs, langid.Samples(())).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in nothing] == ["und"]


def test_phrases_are_longest_matches():
    samples = langid.Samples((("x", "abracadabra"), ("y", "zzzz")))
    tool = langid.Automata(samples)
    text = "abracarb dabrax"
    symbols, counts = tool.read([text])
    sample, at, phrases = "abracadabra", 0, 0
    clean = text.lower()
    while at < len(clean):  # a symbol that the sample lacks joins the phrase after it
        known = int(clean[at] in sample)
        start, n = at + 1 - known, known
        while start + n < len(clean) and clean[start : start + n + 1] in sample:
            n += 1
        at, phrases = start + n, phrases + 1
    assert tool.phrases(symbols, counts)[0][0] == phrases


def brute_substrings(some, size=20):
    order = sorted(((-1 if d is None else d), i) for i, (d, *_) in enumerate(some))
    starts = defaultdict(list)
    for d, i in order:
        w = words(some[i][1])
        for n in range(len(w) - size + 1):
            starts[tuple(w[n : n + size])].append((d, n))
    made = Counter()
    for d, i in order:
        w = words(some[i][1])
        gone = set()
        for n in range(len(w) - size + 1):
            if min(starts[tuple(w[n : n + size])]) < (d, n):
                gone.update(range(n, n + size))
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        made[None if d < 0 else d, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return made


@pytest.mark.parametrize("block", [16_000, 2])
def test_substrings(spark, docs, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        found = substrings.deduplicate(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter(map(tuple, found)) == brute_substrings(rows())


def test_packing(docs, library):
    made = packing.pack_documents(docs, PATH).collect()
    bins = defaultdict(list)
    for r in made:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in made)
    assert total == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows())
    assert len(bins) <= -(-total // 1024) + 1
    long = sorted((r for r in made if r.doc_id == 46), key=lambda r: r.piece)
    ids = np.array([*library.encode(rows()[[r[0] for r in rows()].index(46)][1], add_special_tokens=False).ids, 2], "<u4")
    assert [r.length for r in long[1:]] == [1024] * (len(long) - 1)
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in long)


def test_fullest_bin():
    rng = np.random.default_rng(3)
    for _ in range(50):
        left = {int(n): int(c) for n, c in zip(rng.integers(1, 30, 6), rng.integers(1, 4, 6))}
        room = int(rng.integers(1, 60))
        sums = {0}
        for n, c in left.items():
            sums |= {s + n * k for s in sums for k in range(1, c + 1) if s + n * k <= room}
        chosen = packing.fullest(room, dict(left))
        assert sum(n * m for n, m in chosen.items()) == max(sums)
        assert all(m <= left[n] for n, m in chosen.items())


def test_secrets(spark, docs):
    found = secrets.scan(docs).select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.*").collect()
    assert [(r.doc_id, r.value) for r in found if r.chance > 0.5] == [(60, "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect() if r.doc_id in (44, 60)}
    assert clean[60].startswith('a token = "<secret>" here\n') and clean[44] == "word"
    plan = secrets.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    known = secrets.dictionary(docs)
    findings = secrets.labelled(spark, known, 1200)
    trees = secrets.train(findings.where(F.pmod(F.xxhash64("value"), F.lit(4)) != 0), known)
    held = findings.where(F.pmod(F.xxhash64("value"), F.lit(4)) == 0)
    values = list(secrets.features(F.col("value"), F.col("before"), F.col("after"), F.col("path"), known).values())
    right = held.select((((secrets.chance(trees, values) > 0.5).cast("int")) == F.col("label")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.95


def vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((1500, 16))
    v[100:160] = v[100]
    made = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    made += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 3), (None, [1.0] * 16), (2004, [None] * 16)]
    return spark.createDataFrame(made, "vec_id long, embedding array<float>"), v.astype(np.float32).astype(float)


def test_neighbours(spark):
    df, v = vectors(spark)
    found = defaultdict(list)
    for r in neighbours.search(df.withColumn("part", F.lit("clash")), F.col("vec_id") % 20 == 0).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    assert set(found) == set(range(0, 1500, 20))
    for q, got in found.items():
        like = (v * v[q]).sum(1)
        like[q] = -np.inf
        best = np.lexsort((np.arange(len(v)), -like))[:20]
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(like[i] - s) < 1e-9 for _, i, s in got)
        assert got == sorted(got, key=lambda g: (-g[2], g[1]))
        hits += len({g[1] for g in got} & set(best.tolist()))
    assert hits / (20 * len(found)) >= 0.9
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>")
    found = sorted(map(tuple, neighbours.search(df, F.col("vec_id") % 20 == 0).collect()))
    assert found == [(0, 1, 20, 1.0), (0, 2, 3, 0.0), (20, 1, 0, 1.0), (20, 2, 3, 0.0)]


def test_licenses(spark, docs):
    assert [(r.doc_id, r.license) for r in licenses.scan(docs).collect()] == [(60, "MIT")]
    whole = {name: wordings for name, wordings in licenses.TEMPLATES.items()}
    made = [(n, f"intro\n\n{w}\n\nbody text", None, None, None) for n, w in enumerate(w for ws in whole.values() for w in ws)]
    names = [name for name, ws in whole.items() for _ in ws]
    found = {r.doc_id: r.license for r in licenses.scan(table(spark, made)).collect() if r.license}
    assert all(found.get(n) == name for n, name in enumerate(names)), [(n, name, found.get(n)) for n, name in enumerate(names) if found.get(n) != name]
    altered = "Released under the BEER License."
    (row,) = licenses.scan(table(spark, [(1, altered, None, None, None)])).collect()
    assert row.license is None and row.lacks


def plain_fingerprint(text, n=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(docs):
    found = simhash.near_groups(docs).collect()
    fps = [(d, plain_fingerprint(t)) for d, t, *_ in rows()]
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in found) == Counter(fps)
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = defaultdict(list)
    for n, (d, _) in enumerate(fps):
        least[label[n]].append(d)
    expected = Counter((d, min((x for x in least[label[n]] if x is not None), default=None)) for n, (d, _) in enumerate(fps))
    assert Counter((r.doc_id, r.component_id) for r in found) == expected


def test_links_are_complete(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 40)
    made = set(base.tolist())
    for b in base.tolist():
        for _ in range(30):
            x = b
            for bit in rng.choice(63, rng.integers(1, 7), replace=False).tolist():
                x ^= 1 << bit
            made.add(x)
    made = sorted(made)
    triples = simhash.position_triples()
    assert len(triples) == 20
    for size in (16_384, 4):
        monkeypatch.setattr(simhash, "LIST", size)
        monkeypatch.setattr(simhash, "BLOCK", max(3, size // 4))
        df = spark.createDataFrame([(0, x) for x in made], "kind int, fp long")
        groups = {r.node: r.component for r in graph.components(simhash.links(df)).collect()}
        label = {x: x for x in made}
        for i, x in enumerate(made):
            for y in made[:i]:
                if (x ^ y).bit_count() <= 4 and label[x] != label[y]:
                    a, b = max(label[x], label[y]), min(label[x], label[y])
                    label = {k: b if v == a else v for k, v in label.items()}
        assert {k: groups.get(k, k) for k in made} == label


def test_near_copies(docs):
    found = {(r.doc_id, r.kept_id) for r in simhash.near_copies(docs).collect()}
    assert {(d, 30) for d in (30, 32, 33, 34)} <= found
    assert not {5, 46} & {d for d, _ in found}


def test_fingerprints(docs):
    found = fingerprint.against_next(docs).collect()
    assert len(found) == len(rows())
    by_text = defaultdict(set)
    named = {d: t for d, t, *_ in rows()}
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id not in (None, 50, 51):
            by_text[named[r.doc_id] or ""].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    order = sorted((r for r in rows() if r[0] is not None), key=lambda r: -r[0])
    for (d, t, *_), (_, u, *_) in list(zip(order, order[1:])):
        if d in (50, 51) or d == 60:
            continue
        t, u = t or "", u or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + u[:k]
        (r,) = [r for r in found if r.doc_id == d]
        assert r.n_chars == len(t)
        if order[order.index(next(o for o in order if o[0] == d)) + 1][0] not in (50, 51):
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_fingerprint_search(spark):
    rng = np.random.default_rng(4)
    fps = [(int(a), int(b)) for a, b in rng.integers(-(1 << 62), 1 << 62, (60, 2))]
    for a, b in list(fps):
        for n in (1, 4, 6, 7):
            low, high = a, b
            for bit in rng.choice(124, n, replace=False).tolist():
                low, high = (low ^ 1 << bit, high) if bit < 62 else (low, high ^ 1 << (bit - 62))
            fps.append((low, high))
    df = spark.createDataFrame(fps, "low long, high long")
    mask = (1 << 64) - 1
    apart = lambda x, y: ((x[0] ^ y[0]) & mask).bit_count() + ((x[1] ^ y[1]) & mask).bit_count()
    distinct = sorted(set(fps))
    expected = {(x, y, apart(x, y)) for i, x in enumerate(distinct) for y in distinct[i + 1 :] if apart(x, y) <= 6}
    found = fingerprint.within(df).collect()
    assert {((r.low, r.high), (r.low_2, r.high_2), r.distance) for r in found} == expected and len(found) == len(expected)


def test_pitman_yor(docs):
    flagged = docs.select("doc_id", "text", F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False)).alias("held_out"))
    model = pitman_yor.train(flagged.withColumn("learn", ~F.col("held_out")))
    found = pitman_yor.score(flagged, model).collect()
    counts, ends = Counter(), 0
    for d, t, *_ in rows():
        if d is None or d % 7 != 2:
            counts.update(w.lower() for w in words(t))
            ends += 1
    total, types = sum(counts.values()) + ends, len(counts) + 1
    expected = Counter()
    for d, t, *_ in rows():
        seen = [counts.get(w.lower(), 0) for w in words(t)] + [ends]
        base = sum(np.log10((c + 1) / (total + types + 1)) for c in seen)
        expected[d, len(seen), sum(c > 0 for c in seen), total, round(base, 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.score < 0 for r in found)


def test_byte_chances_sum_to_one():
    keys = np.array([(c << 8) | s for c in range(3) for s in range(256)], np.int64)
    learned = np.random.default_rng(1).integers(0, 5, len(keys))
    rooms = pitman_yor.Restaurants(keys, learned, 0, 1)
    p = rooms.sample(np.random.default_rng(2), np.full(256, 1 / 256))
    assert np.allclose(np.bincount(keys >> 8, p), 1)


@pytest.mark.parametrize("name", ["bpe", "langid", "substrings", "packing", "secrets", "licenses", "simhash", "fingerprint", "pitman"])
def test_empty_table(spark, name):
    df = spark.createDataFrame([], SCHEMA)
    made = {
        "bpe": lambda: bpe.round_trip(df, PATH), "langid": lambda: langid.predict(df, langid.learn(df)),
        "substrings": lambda: substrings.deduplicate(df), "packing": lambda: packing.pack_documents(df, PATH),
        "secrets": lambda: secrets.redact(df), "licenses": lambda: licenses.scan(df), "simhash": lambda: simhash.near_groups(df),
        "fingerprint": lambda: fingerprint.against_next(df),
        "pitman": lambda: pitman_yor.score(df.withColumn("held_out", F.lit(False)), pitman_yor.train(df.withColumn("learn", F.lit(True)))),
    }
    assert made[name]().count() == 0


def alike_groups(texts, similarity=0.8):
    """The group of each text, by all pairs."""
    sets = [{tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))} for w in (words(t.lower()) for t in texts)]
    group = list(range(len(texts)))
    for i, s in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and len(s & sets[j]) >= similarity * len(s | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_near_copies_with_added_and_removed_words(spark):
    texts = []
    for n, size in enumerate((60, 100, 200, 300) * 8):
        base = prose(["w%d" % k for k in range(3000)], size, n).split()
        more = prose(["v%d" % k for k in range(3000)], size // 5, 1000 + n).split()[: size // 5]
        cut = len(base) // 6
        texts += [" ".join(base), " ".join(base + more), " ".join(more + base)] if n % 2 else [" ".join(base), " ".join(base[cut:]), " ".join(base[:-cut])]
    group = alike_groups(texts)
    assert sum(g != n for n, g in enumerate(group)) >= 50
    df = spark.createDataFrame([(n, t, None, None, None) for n, t in enumerate(texts)], SCHEMA).repartition(3)
    found = {r.doc_id: r.kept_id for r in simhash.near_copies(df).collect()}
    assert [found.get(n, n) for n in range(len(texts))] == group


def test_near_copies_beside_an_unlike_representative(spark):
    shared, texts = " ".join("s%d" % n for n in range(60)), []
    for family in range(6):  # unlike families that share most of their shingles, in chains of alike texts
        tail = ["f%d_%d" % (family, n) for n in range(40)]
        for step in range(3):
            changed = ["c%d_%d_%d" % (family, step, n) for n in range(6 * step)]
            texts.append(" ".join([shared, *tail[6 * step :], *changed]))
    df = spark.createDataFrame([(n, t, None, None, None) for n, t in enumerate(texts)], SCHEMA).repartition(3)
    group = alike_groups(texts)
    assert 6 <= len(set(group)) < len(texts)
    # Without rows all texts share one key.
    found = {r.doc_id: r.kept_id for r in simhash.near_copies(df, bands=1, rows=0).collect()}
    assert [found.get(n, n) for n in range(len(texts))] == group


def test_secrets_within_one_word(spark, docs):
    keys = [hashlib.sha1(b"%d" % n).hexdigest() for n in range(3)]
    json = '{"api_key":"%s","auth_token":"%s","name":"x","client_secret":"%s"}' % tuple(keys)
    jwt = ["eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "eyJzdWIiOiIxMjM0NTY3ODkwIiwiaWF0IjoxNTE2MjM5MDIyfQ", "SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"]
    made = [(1, json), (2, "token=" + ".".join(jwt)), (3, "path=/very/long/name123456&token=" + keys[0]), (4, f"A={keys[1]};B={keys[2]} end"), (5, json * 40)]
    df = table(spark, [(d, t, None, "src0", None) for d, t in made] + rows())
    found = {r.doc_id: r.findings for r in secrets.scan(df.drop("findings")).where("doc_id < 6 and length(text) > 60 and source = 'src0'").collect() if r.findings}
    assert [f.value for f in found[1]] == keys and all(f.chance > 0.5 for f in found[1])
    assert [f.before[-len(end) :] for f, end in zip(found[1], ('{"api_key":"', '"auth_token":"', '"client_secret":"'))] == ['{"api_key":"', '"auth_token":"', '"client_secret":"']
    assert [f.value for f in found[2]] == jwt
    assert [f.value for f in found[3]] == ["/very/long/name123456", keys[0]] and found[3][1].chance > 0.5
    assert [f.value for f in found[4]] == keys[1:] and len(found[5]) == 120
    clean = [r.text for r in secrets.redact(df).where("doc_id = 1").collect()]
    assert json.replace(keys[0], "<secret>").replace(keys[1], "<secret>").replace(keys[2], "<secret>") in clean


def test_language_of_copies_has_a_sample(spark):
    made = [(n, "copied words " + prose(DE, 20, n % 5), "de", None, None) for n in range(20_000)]
    made += [(n, prose(EN, 20, n), "en", None, None) for n in range(30_000, 30_200)]
    samples = langid.learn(spark.createDataFrame(made, SCHEMA))
    texts = dict(samples.texts)
    assert sorted(texts) == ["de", "en"] and texts["de"].count("copied words") == 5


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// "])
def test_wrapped_licenses(sign):
    tool = licenses.scanner()
    fill = prose(EN, 300, 3)
    for name, wordings in licenses.TEMPLATES.items():
        for wording in wordings:
            lines = textwrap.fill(wording, 72, initial_indent=sign, subsequent_indent=sign)
            found = [b for b in tool.blocks(f"{fill}\n\n{lines}\n\n{fill}") if b[2]]
            assert [b[2] for b in found] == [name], (name, lines, found)
    mit, bsd = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["BSD-3-Clause"][0]
    mit = mit.replace("conditions: The", "conditions:\n\nThe")
    parts = [textwrap.fill(p, 72, initial_indent=sign, subsequent_indent=sign) for p in (*mit.split("\n\n"), bsd, licenses.TEMPLATES["ISC"][1])]
    for joint in ("\n", f"\n{sign}\n"):
        assert [b[2] for b in tool.blocks(joint.join(parts)) if b[2]] == ["MIT", "BSD-3-Clause", "ISC"]
    one_line = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    assert [b[2] for b in tool.blocks(one_line)] == ["MIT", "Apache-2.0"]
