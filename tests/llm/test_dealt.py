"""The ten operators and the pipeline against brute force, SQL and planted cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiflow.llm import chat, common, crf, decontaminate, licenses, lm, minhash, packing, queries, substrings, suffix, vptree, warc
from lexiflow.llm.components import components

from ..conftest import rows

DOC = "doc_id long, text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def say(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, one word, repeated rows, a very long text, and extra columns with the operators' own names."""
    r = random.Random(3)
    base = say(r, 60)
    near = base.split()
    near[30] = "changed"
    texts = [None, "", " \n\t ", "Single", "Single", base, base, " ".join(near), say(r, 20_000), "é ü 한글 é ü 한글", base + " " + base, "x" * 500]
    data = [(i, t) for i, t in enumerate(texts)] + [(5, base)]
    df = spark.createDataFrame(data, DOC)
    for name in ("key", "id", "block", "score", "words", "component", "_copy", "n_chars", "shard", "row"):
        df = df.withColumn(name, F.lit(7).cast("long"))
    return df


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    ours, theirs = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


# 1 licences


def test_license_phrases_and_templates(spark):
    df = spark.createDataFrame([(1, "MIT License! mit  license\nLicensed under CC-BY NC 4.0."), (2, "gnu general public"), (3, None), (4, "This work is licensed under the GNU Lesser General Public License, v3")], DOC)
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 0, 6, "cc-by,mit")
    assert got[1].labels == "cc-by,cc-by-nc-notice,mit" and got[1].score == 1.0
    assert (got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, None, "", 0.0)
    assert (got[3].n_words, got[3].labels) == (0, "")
    assert "lgpl-notice" in got[4].labels and got[4].base_labels == ""


def test_license_wrapped_lines(spark, tmp_path):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    bsd = "x\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    far = "Permission is hereby granted, free of charge, to any person\n" + "\n" * 4 + "obtaining a copy of this software"
    df = spark.createDataFrame([(1, mit), (2, bsd), (3, far), (4, mit.replace("\n", " ")), (5, None)], DOC)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.labels, r.score) for r in queries.op1_license_scans_wrapped(spark, str(tmp_path)).collect()}
    assert got == {1: ("mit-text", 1.0), 2: ("bsd-notice", 1.0), 3: ("", 0.0), 4: ("mit-text", 1.0), 5: ("", 0.0)}


def test_license_wrapped_anywhere(spark):
    mit = licenses.TEMPLATES["mit-text"][1]
    wrapped = "\n".join(mit.split()[i] for i in range(len(mit.split())))
    filler = " ".join(f"w{i}" for i in range(700))
    cut = " ".join(mit.split()[:40])  # too little of the long template, and all of the short one
    data = [(1, wrapped), (2, f"{filler} {mit} {filler}"), (2, "nothing here"), (3, cut), (None, "Released under the\n\nMIT\nlicense"), (4, f"released {filler} under the mit license")]
    got = [(x.doc_id, x.n_words, x.labels, round(x.score, 3)) for x in licenses.license_scan(spark.createDataFrame(data, DOC)).collect()]
    assert sorted(g for g in got if g[0]) == [(1, 67, "mit-text", 1.0), (2, 2, "", 0.0), (2, 1467, "mit-text", 1.0), (3, 40, "mit-text", 1.0), (4, 705, "mit", 1.0)]
    assert [g[1:] for g in got if g[0] is None] == [(5, "mit,mit-notice", 1.0)]


def test_license_windows_hold_every_half_block(spark):
    words = [str(i) for i in range(1000)]
    got = spark.createDataFrame([(words,), (words[:1],), ([],)], "w array<string>").select(licenses.windows(F.col("w"), 100).alias("b")).collect()
    blocks = {tuple(x) for x in got[0].b}
    assert all(any(set(words[i : i + 50]) <= set(b) for b in blocks) for i in range(951)) and max(map(len, blocks)) == 100
    assert [x.b for x in got[1:]] == [[["0"]], [[]]]


def test_license_join_equals_brute_force(spark):
    r = random.Random(5)
    templates = {f"t{i}": " ".join(r.sample(WORDS, r.randrange(2, 9))) for i in range(12)}
    blocks = [(i, 0, [r.choice(WORDS) for _ in range(r.randrange(0, 14))]) for i in range(300)]
    df = spark.createDataFrame(blocks, "doc_id long, block int, words array<string>")
    for threshold in (0.5, 0.75, 1.0):
        got = {(x.doc_id, x.label): x.containment for x in licenses.similar_blocks(df, templates, threshold).collect()}
        want = {}
        for i, _, words in blocks:
            for label, t in templates.items():
                t = set(t.split())
                if len(t & set(words)) >= threshold * len(t) - 1e-9 and t & set(words):
                    want[i, label] = len(t & set(words)) / len(t)
        assert got == pytest.approx(want)


def test_license_odd(odd, nothing):
    assert licenses.license_scan(odd).count() == 13
    assert licenses.license_scan(nothing).count() == 0
    assert licenses.license_scan(odd, templates={}).count() == 13


# 2 language model


def test_lm_learns_context(spark):
    r = random.Random(1)
    pattern = [(i, " ".join(r.choice(["a b c d", "e f g h"]) for _ in range(200))) for i in range(60)]
    df = spark.createDataFrame([*pattern, (100, "d c b a " * 50), (101, None), (102, "")], DOC)
    got = {x.doc_id: x for x in lm.pseudo_likelihood(df, rounds=8).collect()}
    usual = np.mean([got[i].mean_loglik for i, _ in pattern])
    assert usual > -1.2 > got[100].mean_loglik
    assert (got[101].n_tokens, got[101].pseudo_loglik, got[101].mean_loglik) == (0, 0.0, None)


def test_lm_tells_words_of_a_bucket_apart(spark):
    room = lm.CLASSES * lm.SIZE - lm.BUCKETS
    listed = [f"w{i}" for i in range(room)]
    bucket = zlib.crc32(b"usual") % lm.BUCKETS
    rare = [w for w in (f"rare{i}" for i in range(9000)) if zlib.crc32(w.encode()) % lm.BUCKETS == bucket][:40]
    data = [(i, " ".join(listed)) for i in range(30)] + [(100, "usual " * 20), *((200 + i, w) for i, w in enumerate(rare)), (300, "usual"), (301, rare[0]), (301, rare[0] + " w1"), (302, None)]
    df = spark.createDataFrame(data, DOC)
    counts = lm.word_counts(df)
    words = lm.vocabulary(counts)
    assert sorted(words) == sorted(w.encode() for w in listed)
    shares, others = lm.bucket_shares(counts, words)
    got = {bytes(x.word).decode(): x.share / lm.FINE for x in shares.collect()}
    n = {"usual": 21, **dict.fromkeys(rare, 1), rare[0]: 3}
    total = sum(n.values()) + lm.SMOOTH * (len(n) + 1)
    assert got == pytest.approx({w: np.log((k + lm.SMOOTH) / total) for w, k in n.items()})
    other = {x.bucket: x.other / lm.FINE for x in others.collect()}
    assert len(other) == lm.BUCKETS and sum(np.exp([*got.values(), other[bucket]])) == pytest.approx(1)
    found = sorted((x.doc_id, x.n_tokens, x.pseudo_loglik) for x in lm.pseudo_likelihood(df).collect())
    one = {(i, k): s for i, k, s in found}
    # The network sees the same bucket without neighbours: only the shares differ.
    assert one[300, 1] - one[301, 1] == pytest.approx(got["usual"] - got[rare[0]], abs=1e-5)
    assert one[201, 1] == one[239, 1] and len(found) == len(data) and one[302, 0] == 0


def test_lm_probabilities_sum_to_one():
    net = lm.Network()
    context = np.tile(np.array([[1, 2, 3, 4]], np.int32), (lm.PAD, 1))
    assert np.exp(net.run(context, np.arange(lm.PAD, dtype=np.int32)).astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_lm_gradient():
    net = lm.Network()
    r = np.random.default_rng(0)
    context, y = r.integers(0, lm.PAD, (256, 4)).astype(np.int32), r.integers(0, 64, 256).astype(np.int32)
    before = net.run(context, y).mean()
    for _ in range(30):
        net.run(context, y, learn=True)
    assert net.run(context, y).mean() > before + 1


def test_lm_odd(odd, nothing):
    assert lm.pseudo_likelihood(odd).count() == 13
    assert lm.pseudo_likelihood(nothing).count() == 0


# 3 near duplicates


def sets_of(data, size):
    out = {}
    for i, t in data:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def brute_components(sets, percent=80):
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    r = random.Random(size)
    data = [(i, say(r, r.randrange(1, 60))) for i in range(60)] + [(60, None), (61, ""), (62, "  \n"), (63, "One"), (64, "one")]
    base = say(r, 120).split()
    for i in range(100, 180):  # a group of near copies, some beyond the limit
        words = list(base)
        for _ in range(r.randrange(0, 12)):
            words[r.randrange(len(words))] = r.choice(WORDS)
        data.append((i, " ".join(words)))
    data += [(200 + i, " ".join(base)) for i in range(20)]
    sets, got = sets_of(data, size), minhash.near_duplicates(spark.createDataFrame(data, DOC), size=size).collect()
    assert {x.doc_id: x.n_shingles for x in got} == {i: len(s) for i, s in sets.items()}
    assert {x.doc_id: x.component_id for x in got} == brute_components(sets)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_near_duplicates_where_the_lead_met_one_member(spark):
    def sketch(words):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        values, ends = minhash.shingle_sets(data, np.array([0, len(data)]), 1)
        return minhash.sketches(values, ends, minhash.BANDS * minhash.ROWS)[0]

    base = [f"base{i}" for i in range(84)]
    own = sketch(base)
    # Words that change no coordinate: all three sets meet in every bucket, and the largest id leads each.
    quiet = [w for w in (f"word{i}" for i in range(3000)) if (sketch([*base, w]) == own).all()]
    assert len(quiet) >= 51
    p, q, lead = base + quiet[:6], base + quiet[:1] + quiet[6:21], base + quiet[21:51]
    data = [(1, " ".join(p)), (2, " ".join(q)), (3, " ".join(lead))]  # p and q: 85 of 105; p is too small to be compared with the lead
    sets, got = sets_of(data, 1), minhash.near_duplicates(spark.createDataFrame(data, DOC), size=1).collect()
    assert brute_components(sets) == {1: 1, 2: 1, 3: 3}
    assert {x.doc_id: x.component_id for x in got} == brute_components(sets)


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    both, mine, other = (r.integers(1, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    a, b = np.unique(np.concatenate([both, mine])), np.unique(np.concatenate([both, other]))
    s = minhash.sketches(np.concatenate([a, b, a[:1]]), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 1]), 512)
    assert (s[0] == s[1]).mean() == pytest.approx(0.6, abs=0.1)
    assert (s != np.uint64(2**64 - 1)).all()  # one element fills every coordinate


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {x.id: x.component for x in components(edges).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 101: 100}


def test_near_duplicates_odd(odd, nothing):
    got = minhash.near_duplicates(odd, size=2).collect()
    assert len(got) == 13
    by = {x.doc_id: x for x in got}
    assert by[4].component_id == 3 and by[6].component_id == by[7].component_id == 5 and not by[6].kept
    assert [by[i].n_shingles for i in (0, 1, 2, 3)] == [0, 0, 0, 1] and by[1].kept
    assert minhash.near_duplicates(nothing).count() == 0


# 4 chat


def test_chat_collapse(spark):
    turns = {1: ["a", "b", "c"], 2: ["a", "b"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: ["b", "a"], 6: ["a"], 7: [None, "b"]}
    data = [(c, k, "user" if k % 2 == 0 else "assistant", t, 9) for c, x in turns.items() for k, t in enumerate(x)]
    df = spark.createDataFrame([*data, data[0], (None, 0, "user", "z", 9)], "conv_id long, turn long, role string, text string, k long")
    got = {x.conv_id: x for x in chat.chat_format(df).collect()}
    assert sorted(got) == [1, 4, 5, 7]
    assert got[4].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert got[7].rendered.startswith("<|im_start|>user\n<|im_end|>")
    assert chat.chat_format(df.where("false")).count() == 0


# 5 suffix arrays


@pytest.mark.parametrize("seed", range(12))
def test_suffix_order(seed):
    r = random.Random(seed)
    text = bytes(r.randrange(r.choice([1, 2, 4, 256])) for _ in range(r.randrange(1, 400)))
    text = text[:15] * 12 if seed % 3 == 0 else text
    block = np.frombuffer(text, np.uint8)
    assert suffix.suffix_order(block, depth=len(text) + 8).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute_repeats(data, length=100):
    seen, out = set(), []
    for i, text in sorted((i, (t or "").encode()) for i, t in data):
        cover = np.zeros(len(text) + 1, int)
        for k in range(len(text) - length + 1):
            w = text[k : k + length]
            if w in seen:
                cover[k] += 1
                cover[k + length] -= 1
            seen.add(w)
        gone = np.cumsum(cover)[: len(text)] > 0
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out.append((i, len(text), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 3000}, {"block_bytes": 3000, "hot": 2}])
def test_repeats_equal_brute_force(spark, settings):
    r = random.Random(8)
    shared = [say(r, n) for n in (12, 16, 30, 80)]
    data = [(i, " ".join(r.choice([say(r, 9), r.choice(shared), "é" * 70, "ab" * 60]) for _ in range(r.randrange(0, 7)))) for i in range(60)]
    data += [(60, None), (61, ""), (62, "z" * 350), (63, data[5][1]), (63, data[5][1])]
    got = substrings.remove_repeats(spark.createDataFrame(data, DOC), **settings).collect()
    ours = sorted((x.doc_id, x.n_bytes, sum(e - s for s, e in zip(x.starts, x.ends, strict=True)), len(x.starts), hashlib.sha256(x.kept_text).hexdigest()) for x in got)
    assert ours == brute_repeats(data)


def test_repeats_keep_whole_characters(spark):
    data = [(1, "ö" * 90 + "x"), (2, "ö" * 80)]
    got = {x.doc_id: x for x in substrings.remove_repeats(spark.createDataFrame(data, DOC), characters=True).collect()}
    assert bytes(got[2].kept_text).decode() == "" and bytes(got[1].kept_text).decode().startswith("ö")


def test_repeats_odd(odd, nothing):
    assert substrings.remove_repeats(odd).count() == 13
    assert substrings.remove_repeats(nothing).count() == 0


# 6 packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = random.Random(4)
    texts = [None, "", "it's  IT'S\n\n x\t", "naïve ½ 한글   <|endoftext|> ªº", say(r, 3000), *(say(r, r.randrange(1, 300)) for _ in range(80))]
    got = packing.packed(spark.createDataFrame(list(enumerate(texts)), DOC).repartition(2)).collect()
    pieces, fill = {}, {}
    for x in got:
        assert x.ids_crc32 == zlib.crc32(x.ids) and x.length == len(x.ids) // 4
        pieces.setdefault(x.doc_id, []).append((x.start, bytes(x.ids), x.doc_tokens))
        fill.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for i, text in enumerate(texts):
        want = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        own = sorted(pieces[i])
        assert b"".join(b for _, b, _ in own) == want and all(n == len(want) // 4 for *_, n in own)
    lengths = []
    for parts in fill.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048
        lengths.append(end)
    assert sum(n < 2048 for n in lengths) <= 2  # the last of each task


def test_packing_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"x  {end}\n\n{end} 한글 ½{end}", "<|endoftext|", f"<{end}>", "it's plain", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), DOC)
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = {x.doc_id: bytes(x.ids) for x in packing.packed(df, special=True).collect()}
    want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, x in enumerate(texts)}
    assert got == want
    df.write.parquet(str(tmp_path / "documents.parquet"))
    crc = {x.doc_id: x.ids_crc32 for x in queries.op6_packing(spark, str(tmp_path)).collect()}
    assert crc == {i: zlib.crc32(b) for i, b in want.items()}
    assert {x.doc_id: bytes(x.ids) for x in corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect()} == want


def test_packing_limits():
    r = random.Random(2)
    items = [packing.Piece(i, bytes(4 * r.randrange(1, 90)), r.randrange(0, 40)) for i in range(300)]
    loss, segments, tokens = {}, {}, {}
    total = sum(p.left for p in items)
    for p, start, n, s, _ in packing.pack(iter(items), 256, 5, 100):
        tokens[s] = tokens.get(s, 0) + n
        segments[s] = segments.get(s, 0) + 1
        loss[s] = loss.get(s, 0) + max(0, start + n - max(start, p.loss_from))
    assert max(tokens.values()) <= 256 and max(segments.values()) <= 5 and max(loss.values()) <= 100
    assert sum(tokens.values()) == total


def test_packing_prompts_bear_no_loss(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(21)
    texts = [say(r, r.randrange(1, 60)) + r.choice(["\n", "\r\n", " "]) + say(r, r.randrange(1, 400)) for _ in range(150)] + ["\n", "one line", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(1)
    loss, tokens, sums = {}, {}, {}
    for x in packing.packed(df, max_segments=6, max_loss=1500, prompt=packing.first_line(), special=True).collect():
        loss[x.doc_id] = loss.get(x.doc_id, 0) + x.loss_tokens
        tokens[x.doc_id] = x.doc_tokens
        one = sums.setdefault(x.sequence_id, [0, 0, 0])
        one[:] = one[0] + x.length, one[1] + 1, one[2] + x.loss_tokens
    count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    for i, s in enumerate(texts):
        prompt = (s or "").split("\n")[0] + "\n" if "\n" in (s or "") else ""
        assert loss[i] == tokens[i] - count(prompt)
    assert all(a <= 2048 and b <= 6 and c <= 1500 for a, b, c in sums.values()) and max(c for *_, c in sums.values()) == 1500
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows_ = queries.op6_packing(spark, str(tmp_path)).collect()
    whole = {}
    for x in rows_:
        whole.setdefault(x.doc_id, []).append((x.start, x.length, x.ids_crc32))
    for i, s in enumerate(texts):
        ids, at = np.array([*t.encode(s or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for start, length, crc in sorted(whole[i]):
            assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)


def test_packing_odd(odd, nothing):
    assert packing.packed(odd).select("doc_id").distinct().count() == 12
    assert packing.packed(nothing).count() == 0


# 7 WARC


def test_fixity_audit(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>" + "y" * (i % 50)) for i in range(0, 9000, 3)] + [(3, None, None), (None, "u", "h"), (6, "http://x/6", "<p>yyyyyy")], "page_id long, url string, html string")
    records = warc.warc_records(pages)
    assert records.count() == 3000
    broken = F.concat(F.expr("substring(record, 1, 20)"), F.lit(b"?"), F.expr("substring(record, 22)"))
    replica = records.where("page_id <> 300").withColumn("record", F.when(F.col("page_id") == 4500, broken).otherwise(F.col("record")))
    extra = records.where("page_id = 300").withColumn("place", F.lit(1).cast("long")).withColumn("page_id", F.lit(1).cast("long"))
    got = {x.page_id: x.status for x in warc.fixity_audit(records, replica.unionByName(extra)).where("status <> 'ok'").collect()}
    assert got == {300: "missing", 4500: "corrupt", 1: "extra"}
    assert warc.fixity_audit(records, records).where("status <> 'ok'").count() == 0
    assert warc.differing_leaves(records, records).count() == 0
    none = records.where("false")
    assert warc.fixity_audit(records, none).where("status = 'missing'").count() == 3000
    assert warc.fixity_audit(none, none).count() == 0


# 8 nearest neighbours


def test_tiles_of_shards_and_blocks_are_bounded():
    assert vptree.tile_sides(5, 2, 1 << 23, 1 << 20) == (1, 1)
    assert vptree.tile_sides(6104, 2442, 1 << 23, 1 << 20) == (16, 64)  # 10^8 vectors of 64 doubles: 14,898 tiles
    assert vptree.tile_sides(6104, 2442, 1 << 28, 1 << 25) == (1, 2)  # wide vectors: bounded by bytes
    assert vptree.tile_sides(1, 10**6, 1 << 23, 1 << 20) == (1, 64)


@pytest.mark.parametrize("tasks", [1, 6, vptree.TASKS])  # one tile of all pairs, tiles of several, a tile for each pair
def test_nearest_is_exact_with_factor_one(spark, tasks):
    r = np.random.default_rng(2)
    v = r.normal(size=(700, 12))
    v[100:160] = v[7]  # copies: ties go to the smaller id
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [float("inf")] + [1.0] * 11)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("shard", F.lit(1))
    got = {}
    for x in vptree.nearest(df, df.where("vec_id % 20 = 0"), k=20, factor=1.0, shard=200, leaf=16, block=10, tasks=tasks).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    assert sorted(got) == list(range(0, 700, 20))
    for q, found in got.items():
        score = (v * v[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(700), -score)) if i != q][:20]
        assert [i for _, i, _ in sorted(found)] == want
        assert [s for *_, s in sorted(found)] == pytest.approx(score[want].tolist())


@pytest.mark.parametrize("factor", [1.0, vptree.FACTOR])
def test_nearest_ties_of_different_vectors(spark, factor):
    r = np.random.default_rng(4)
    v = r.integers(-2, 3, (1500, 5)).astype(float)
    v = v[(v != 0).any(axis=1)]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for x in vptree.nearest(df, df.where("vec_id % 20 = 0"), k=20, factor=factor, shard=300, leaf=32, block=20).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id))
    same = 0
    for q, found in got.items():
        score = (v * v[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(len(v)), -score)) if i != q][:20]
        same += [i for _, i in sorted(found)] == want
    assert same == len(got) if factor == 1 else same >= 0.9 * len(got)


@pytest.mark.parametrize("kind", ["normal2", "normal4", "normal8", "normal16", "normal64", "normal128", "clustered8", "clustered64", "unit16", "integer6"])
def test_tree_recall(kind):
    r, n = np.random.default_rng(0), 4096
    d = int(kind.lstrip("abcdefghijklmnopqrstuvwxyz"))
    v = r.normal(size=(n, d))
    if kind.startswith("clustered"):
        centres = r.normal(size=(40, d))
        v = centres[r.integers(0, 40, n)] + 0.2 * v
    elif kind.startswith("unit"):
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    elif kind.startswith("integer"):
        v = np.unique(r.integers(-3, 4, (n, d)).astype(float), axis=0)
    last = np.sqrt(np.maximum((v**2).sum(axis=1).max() - (v**2).sum(axis=1), 0))
    tree = vptree.Tree(np.concatenate([v, last[:, None]], axis=1), 64)
    q = v[::20]
    score = q @ v.T
    score[np.arange(len(q)), np.arange(len(q)) * 20] = -np.inf
    want = np.lexsort((np.broadcast_to(np.arange(len(v)), score.shape), -score), axis=1)[:, :20]
    for factor, least in ((1.0, 1.0), (vptree.FACTOR, 0.95)):
        rows, _, _ = tree.search(v, q, 20, factor, np.arange(len(q)) * 20)
        assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(rows.tolist(), want.tolist(), strict=True)]) >= least


def test_nearest_odd(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    for name in ("v", "ids", "shard", "block", "score", "rank", "query_id", "tree", "label"):
        df = df.withColumn(name, F.lit("7"))
    assert [(x.query_id, x.vec_id) for x in vptree.nearest(df, df, k=20).orderBy("query_id").collect()] == [(0, 20), (20, 0)]
    assert vptree.nearest(df.where("false"), df, k=20).count() == 0
    assert vptree.nearest(df, df.where("false"), k=20).count() == 0


def test_recall(spark, sf_dir):
    v = common.table(spark, sf_dir, "embeddings")
    exact, ours = ({(x.query_id, x.vec_id) for x in vptree.nearest(v, v.where("vec_id % 20 = 0"), factor=f).collect()} for f in (1.0, vptree.FACTOR))
    assert len(exact & ours) >= 0.9 * len(exact)


# 9 decontamination


def brute_hits(text, items, window=13):
    words, hit, found = decontaminate.words_of((text or "").encode()), set(), set()
    for i, t in items:
        w = decontaminate.words_of((t or "").encode())
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[k : k + n]:
                    hit.update(range(p, p + n))
                    found.add(i)
    return len(words), hit, sorted(found)


@pytest.mark.parametrize("shard_words", [200_000, 60])
def test_contamination_equals_brute_force(spark, shard_words):
    r = random.Random(6)
    few = WORDS[:5]
    items = [(i, " ".join(r.choice(few) for _ in range(r.randrange(0, 22)))) for i in range(25)] + [(30, None), (31, "ALPHA-beta"), (31, "ALPHA-beta")]
    data = []
    for i in range(80):
        parts = [" ".join(r.choice(few) for _ in range(r.randrange(0, 30))), r.choice(items)[1] or ""]
        data.append((i, "  ".join(r.sample(parts, 2)).upper()))
    data += [(90, None), (91, ""), (91, "")]
    got = decontaminate.judged(decontaminate.contamination(spark.createDataFrame(data, DOC), spark.createDataFrame(items, "item_id long, text string"), shard_words=shard_words)).collect()
    assert len(got) == len(data)
    text = dict(data)
    for x in got:
        n, hit, found = brute_hits(text[x.doc_id], items)
        assert (x.n_words, x.n_hit, list(x["items"])) == (n, len(hit), found)
        assert x.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)


@pytest.mark.parametrize("shard_words", [200_000, 60])
def test_spans_are_cut(spark, shard_words):
    r = random.Random(12)
    item = say(r, 80).split()
    filler = [say(r, n) for n in (30, 3000, 3000, 40)]
    data = [
        (1, f"{filler[0]}, {' '.join(item)}. {filler[3]}"),  # over the coverage: all of it goes
        (2, f"{filler[1]}  ({' '.join(item).upper()})\n{filler[2]}"),  # below it, but a long passage
        (3, f"{filler[1]} {' '.join(item[:20])} {filler[2]}"),  # below both: stays
        (4, filler[1]), (5, None), (6, ""), (None, " ".join(item)),
    ]
    docs = spark.createDataFrame(data, DOC).withColumn("starts", F.lit("mine")).withColumn("carried", F.lit(1)).withColumn("items", F.lit(2.5))
    items = spark.createDataFrame([(1, " ".join(item)), *((10 + i, say(r, 30)) for i in range(4))], "item_id long, text string")
    got = {x.carried.doc_id: x for x in decontaminate.without_spans(docs, items, max_words=50, max_share=0.05, shard_words=shard_words).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and {i: (x.contaminated, x.n_cut) for i, x in got.items()} == {1: (True, 1), 2: (False, 1), 3: (False, 0), 4: (False, 0), 5: (False, 0), 6: (False, 0)}
    assert got[1].kept_text == f"{filler[0]}, . {filler[3]}" and got[2].kept_text == f"{filler[1]}  ( )\n{filler[2]}"
    assert [got[i].kept_text for i in (3, 4, 5, 6)] == [data[2][1], filler[1], None, ""]
    assert all(x.carried.starts == "mine" and x.carried.carried == 1 for x in got.values())


def test_automaton_is_linear_in_repeats():
    import time

    took = []
    for n in (4000, 32_000):
        began = time.perf_counter()
        machine = decontaminate.Automaton([(1, [b"a"] * n)], 13)
        assert machine.matches([b"a"] * n) == ([(0, n)], {1})
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 0.5


def test_contamination_odd(spark, odd, nothing):
    items = spark.createDataFrame([(1, "single")], "item_id long, text string")
    assert decontaminate.judged(decontaminate.contamination(odd, items)).where("contaminated").count() == 2
    assert decontaminate.contamination(nothing, items).count() == 0
    assert decontaminate.contamination(odd, items.where("false")).where("size(items) > 0").count() == 0


# 10 quality


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op10_quality_classifier(spark, sf_dir).join(common.table(spark, sf_dir, "labels"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.93
    assert got.score.between(0, 1).all()


def test_crf_marginals_equal_enumeration():
    from itertools import product

    r = np.random.default_rng(0)
    counts = np.array([3, 1, 4])
    batch = crf.Batch(r.random((8, crf.BASE)), np.ones(8), counts)
    w, pair = r.normal(size=batch.x.shape[1]), r.normal(size=(2, 2))
    bad, joint = batch.marginals(w, pair)
    emit, at, total = batch.x @ w, 0, np.zeros((2, 2))
    for n in counts:
        z, p = 0.0, np.zeros(n)
        pairs = np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            s = np.exp(sum(emit[at + k] * y[k] for k in range(n)) + sum(pair[y[k], y[k + 1]] for k in range(n - 1)))
            z += s
            p += s * np.array(y)
            for k in range(n - 1):
                pairs[y[k], y[k + 1]] += s
        assert bad[at : at + n] == pytest.approx(p / z)
        total += pairs / z
        at += n
    assert joint == pytest.approx(total)


def test_quality_odd(spark, odd, nothing):
    labels = spark.createDataFrame([(5, 1), (6, None), (7, 1), (10, 0), (11, 0), (11, 1)], "doc_id long, quality int")
    model = crf.fit_quality(odd, labels)
    got = crf.quality_scores(odd, model).collect()
    assert len(got) == 13 and all(0 <= x.score <= 1 for x in got)
    assert crf.quality_scores(nothing, model).count() == 0
    assert len(crf.quality_scores(odd, crf.fit_quality(odd, labels, train_bytes=100)).collect()) == 13
    flat = crf.fit_quality(odd, labels.where("false"))
    assert {x.score for x in crf.quality_scores(odd, flat).collect()} == {0.5}


# pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir))
        assert docs.columns == columns, name
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(kept, kept[1:], strict=False))
    data = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in common.table(spark, sf_dir, "benchmark").collect()]
    assert not [i for i, t in data for n, hit, _ in [brute_hits(t, items)] if hit and 20 * len(hit) >= n]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept[-1]


def test_pipeline_dedups(spark):
    r = random.Random(9)
    base, passage = say(r, 200), say(r, 60)
    data = [(1, base), (2, base), (3, base + " more"), (4, say(r, 100) + " " + passage), (5, say(r, 90) + " " + passage), (6, None), (7, "")]
    docs = spark.createDataFrame(data, DOC).withColumn("n_chars", F.length("text").cast("long")).withColumn("_x", F.lit(1))
    one = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(x.doc_id for x in one.collect()) == [1, 4, 5, 6, 7]
    cut = {x.doc_id: x for x in corpus_pipeline.passage_dedup(spark, common.materialise(one), "").collect()}
    assert passage in cut[4].text and passage not in cut[5].text and cut[5].n_chars == len(cut[5].text) and cut[5].text
    assert cut[1].text == base and cut[6].text is None


@pytest.mark.parametrize("k", range(5))
def test_pipeline_odd(spark, odd, sf_dir, k):
    name, stage = corpus_pipeline.STAGES[k]
    for c in ("quality_score", "copy", "no_text", "carried", "starts", "kept_text", "contaminated", "a.b", "_quality", "_null", "ROW"):
        odd = odd.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    odd = odd.drop("row")
    docs = common.materialise(odd)
    out = stage(spark, docs, sf_dir)
    out.count()
    empty = stage(spark, docs.where("false"), sf_dir)
    assert empty.count() == 0
    if k < 4:
        assert out.columns == docs.columns
        for x in out.collect():  # no column is overwritten, whatever its name
            assert all(x[c] == f"{c}{x.doc_id}" for c in docs.columns if c in ("quality_score", "copy", "no_text", "carried", "starts", "kept_text", "contaminated", "a.b", "_quality", "_null", "ROW"))
            assert x["key"] == x["_copy"] == x["shard"] == 7
