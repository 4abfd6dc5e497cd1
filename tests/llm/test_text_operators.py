"""Operators on single texts: personal data, quality, pieces, packing, toxicity, chat, shards."""

from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tagframe.llm import chat, packing, pii, quality, sentencepieces, sharding, toxicity, wordbpe
from tagframe.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.oracle import assert_same, rows

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


# Personal data


def test_base_spans_of_odd_texts(spark):
    texts = ["a@b.c_d@e.f x@y.z", "1.2.3.4.5.6.7.8.9 001.02.3.255", "9" * 20000, "a" * 30000 + "@b.c", "1." * 9000, "+1" + " " * 30000, "x@a." + "b." * 9000 + "c", "é🎉 a@b.cc +49 30 1234567"]
    texts += [t for _, t, *_ in brute.odd_documents()]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digests(df).collect()}
    for k, t in enumerate(texts):
        assert got[k]["base_sha256"] == brute.sha(",".join(brute.base_spans(t))), t


def pii_corpus(spark):
    """Ana stands beside one address only, in different contexts; 'hello' stands everywhere."""
    texts = [f"hello number {k} Ana Quirke wrote from ana@example.com about topic{k}" for k in range(4)] + [f"hello from user{k}@example.com and text{k}" for k in range(40)] + ["hello there"] * 200
    return spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], brute.SCHEMA)


def test_disclosing_terms(spark):
    df = pii_corpus(spark)
    got = {r["doc_id"]: r for r in pii.spans(df).collect()}
    terms = {t["value"] for k in range(4) for t in got[k]["terms"]}
    assert {"Ana", "Quirke"} <= terms and "hello" not in terms and "from" not in {t["value"] for k in range(4, 44) for t in got[k]["terms"]}
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert all(texts[k][t["start"] : t["end"]] == t["value"] for k in got for t in got[k]["terms"])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert len(clean) == len(texts) and "ana" not in clean[0].lower() and "[EMAIL]" in clean[0] and clean[100] == texts[100]


def test_disclosing_terms_far_from_the_entity(spark):
    far = " and so on" * 40
    texts = [f"hello {k} Ana wrote from ana@example.com{far} Ana was here" for k in range(3)] + [f"hello {k}{far} text" for k in range(200)] + ["Ana alone"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all("Ana" not in clean[k] for k in range(3)) and clean[203] == "Ana alone"


def test_pii_edge_tables(spark):
    df = brute.documents(spark)
    assert pii.digests(df).count() == df.count() == pii.sanitise(df).count()
    assert pii.sanitise(df).columns == df.columns
    assert pii.digests(brute.empty(spark)).count() == 0


# Quality rules


def repeat_words(words: list[str]) -> int:
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    n = Counter(windows)
    return len({k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(8)})


def test_quality_counts(spark):
    df = brute.documents(spark)
    expected = []
    for doc_id, text, *_ in brute.odd_documents():
        t = text or ""
        words = brute.WORD.findall(t)
        lines = [x for x in t.split("\n") if brute.WORD.search(x)]
        r = repeat_words(words)
        failed = len(words) < 20 or 100 * r > 30 * len(words)
        expected.append((doc_id, len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), r, failed))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.score(df)
    assert rows(names, [tuple(r) for r in got.select(names).collect()]) == rows(names, expected)
    assert got.where("kept AND base_failed").count() == 0 and quality.score(brute.empty(spark)).count() == 0
    assert quality.keep(df).count() == got.where("kept").count() and quality.keep(df).columns == df.columns


# SentencePiece


def test_pieces(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECES)
    texts = [t or "" for _, t, *_ in brute.odd_documents()]
    for t, (ids, starts, ends) in zip(texts, sentencepieces.encoder(PIECES).encode(texts), strict=True):
        assert ids.tolist() == library.encode(t)
        data = t.encode()
        assert b"".join(data[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)) == data
    df = brute.documents(spark)
    got = sentencepieces.digests(df, PIECES).collect()
    expected = Counter((d, len(i := library.encode(t or "")), brute.sha(",".join(map(str, i))), brute.sha(library.decode(i))) for d, t, *_ in brute.odd_documents())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == expected
    back = sentencepieces.decode(sentencepieces.encode(df, PIECES), PIECES)
    assert Counter(tuple(r) for r in back.collect()) == Counter((d, library.decode(library.encode(t or ""))) for d, t, *_ in brute.odd_documents())
    assert sentencepieces.digests(brute.empty(spark), PIECES).count() == 0


def compiled_map(pairs: dict[str, str]) -> bytes:
    """A double-array trie over the keys, and the replacements: every node gets a block of its own."""
    block, units, strings = 256, {}, b""
    root: dict = {}
    for key, value in pairs.items():
        node = root
        for b in key.encode():
            node = node.setdefault(b, {})
        node[None] = len(strings)
        strings += value.encode() + b"\0"
    nodes = [(root, 0)]
    next_block = block
    while nodes:
        node, at = nodes.pop()
        base = next_block
        next_block += block
        offset = at ^ base
        leaf = None in node
        coded = offset << 10 if offset < 1 << 21 else None
        assert coded is not None
        units[at] = (units.get(at, 0) & 0xFF) | coded | (256 if leaf else 0)
        if leaf:
            units[base] = 0x80000000 | node[None]
        for b, child in node.items():
            if b is not None:
                units[base ^ b] = b
                nodes.append((child, base ^ b))
    array = [units.get(k, 0x80000000) for k in range(next_block)]
    return struct.pack("<I", 4 * len(array)) + struct.pack(f"<{len(array)}I", *array) + strings


@pytest.mark.parametrize("squeeze", [False, True])
def test_character_map(squeeze):
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.precompiled_charsmap = compiled_map({"ﬁ": "fi", "A": "a", "AB": "xy", "\t": " ", "½": "1/2", "§": ""})
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    model = proto.SerializeToString()
    library, mine = SentencePieceProcessor(model_proto=model), sentencepieces.Encoder(model)
    for t in ["ABA ﬁnd ½ of it", "  two  spaces\tand tab ", "§A§", "", "   ", "é AB½", "AAAB"]:
        ids, starts, ends = next(iter(mine.encode([t])))
        assert ids.tolist() == library.encode(t), t
        assert all(0 <= i <= j <= len(t.encode()) for i, j in zip(starts.tolist(), ends.tolist(), strict=True))
    start = mine.normalise("½ x")[1]
    assert start.tolist()[:6] == [0, 0, 0, 0, 0, 0] and start[-1] == 4


# Packing


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    texts = [t or "" for _, t, *_ in brute.odd_documents()] + [f"word{k} and more words here" * (k % 40) for k in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    ids = [np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for t in texts]
    packed = packing.pack(df, WORDS, keep_ids=True)
    got = packed.collect()
    parts, bins = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()
        assert zlib.crc32(part) == r["ids_crc32"] and bytes(r["ids"]) == part and r["doc_tokens"] == len(ids[r["doc_id"]])
        parts[r["doc_id"]].append((r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, x in enumerate(ids):
        assert sum(n for _, n in parts[k]) == len(x) and [s for s, _ in sorted(parts[k])] == [0, *np.cumsum([n for _, n in sorted(parts[k])])[:-1]]
    for x in bins.values():
        assert [o for o, _ in sorted(x)] == [0, *np.cumsum([n for _, n in sorted(x)])[:-1]] and sum(n for _, n in x) <= 2048
    assert sorted(bins) == list(range(len(bins)))
    assert packing.sequences(packed).count() == len(bins)
    p = packing.padding(packed).first()
    assert p["padding"] <= 0.02 * p["tokens"] + 2048
    assert packing.pack(brute.empty(spark), WORDS).count() == 0
    assert packing.pack(brute.documents(spark), WORDS).select(F.sum("length")).first()[0] > 0


def test_word_ids():
    from tokenizers import Tokenizer

    library, encode = Tokenizer.from_file(WORDS), wordbpe.word_encoder(WORDS)
    for t in ["don't I've x's 'S", "Ünïcode İstanbul ΣΑΣ ß ſt ﬁ", "a\x1cb c\x85d e\xa0f", "<|endoftext|> x<|startoftext|>y ***", "été", "日本 語🎉", "12ab!! 3.5", "", "K ª º ĳ"]:
        assert np.frombuffer(encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


# Toxicity


def test_restoring():
    clean = "idiot moron stupid trash pathetic worthless the and then there river water house people".split()
    channel = toxicity.Channel(Counter({w: 40 for w in clean}))
    for seen, meant in {"1d10t": "idiot", "m0r0n": "moron", "$tupid": "stupid", "i.d.i.o.t": "idiot", "traaash": "trash", "p4th3t1c": "pathetic", "st*pid": "stupid"}.items():
        assert meant in toxicity.restore(seen, channel), seen
    assert toxicity.restore("river,", channel) == ("river",)


def every_path(channel: toxicity.Channel, token: str) -> dict[str, float]:
    """The best price of each last context, over all paths of the lattice."""
    best: dict[str, float] = {}

    def walk(k: int, said: str, price: float) -> None:
        context = ("^^" + said)[-2:]
        if k == len(token):
            end = price + channel.step(context, "$")
            best[context] = max(end, best.get(context, end))
            return
        sign = token[k]
        options = [(c, toxicity.LEET_PRICE) for c in toxicity.LEET.get(sign, "")]
        options += [(c, toxicity.WILD_PRICE) for c in channel.alphabet] if sign in toxicity.WILDCARDS else []
        options += [(sign, 0.0)] if sign.isalpha() else []
        if sign in toxicity.SEPARATORS or not options:
            walk(k + 1, said, price + toxicity.DROP_PRICE)
        if k and token[k - 1] == sign and said and said[-1] in {c for c, _ in options}:
            walk(k + 1, said, price + toxicity.REPEAT_PRICE * (k > 1 and token[k - 2] != sign))
        for c, extra in options:
            walk(k + 1, said + c, price + extra + channel.step(context, c))

    walk(0, "", 0.0)
    return best


def test_viterbi_against_all_paths():
    channel = toxicity.Channel(Counter({"idiot": 9, "tote": 4, "lie": 2, "beta": 1}))
    for token in ("1d10t", "t**e", "*#*", "b3..ta", "l1!e", "ttt0te", "i d ! o t", "é1!|", "+(€", "--"):
        best = every_path(channel, token)
        assert sorted(p for p, _ in channel.candidates(token)) == pytest.approx(sorted(best.values())), token


def test_long_tokens():
    channel = toxicity.Channel(Counter({"idiot": 9}))
    for token in ("ab" * 500_000, "1" * 1_000_000, "x" * 1_000_000, "a" + "!" * 500_000, "ab" * 250_000 + "1"):
        assert toxicity.parts(token)[0] == token.strip(toxicity.EDGES)
    assert max(channel.candidates("i1" * 50_000))[1]


def test_disguised_documents_are_found():
    """The channel against the same model without it."""
    insult = ["idiot", "moron", "stupid"]
    texts = [f"you are such a {insult[k % 3]} as ever w{k}" for k in range(90)] + [f"nothing much to see here w{k}" for k in range(300)]
    model = toxicity.Model(texts, [1] * 90 + [0] * 300)
    said = ["1d10t", "m0r0n", "$tup1d", "i d i o t", "m.o.r.o.n", "stuuupid", "st*pid"]
    nothing = model.score("you saw nothing", {})
    assert all(model.score(f"you saw {w}", {}) > 5 * nothing for w in said)
    plain = [toxicity.parts(w)[0] for w in said]
    assert not any(f in model.weights for w in plain for f in toxicity.features([w]))


def test_spaced_words_are_scored():
    texts = [f"you are an idiot w{k}" for k in range(40)] + [f"what an ass w{k}" for k in range(40)] + [f"so stupid w{k}" for k in range(40)] + [f"nothing to see here w{k}" for k in range(300)]
    model = toxicity.Model(texts, [1] * 120 + [0] * 300)
    plain = {w: model.score(w, {}) for w in ("idiot", "ass", "stupid")}
    nothing = model.score("nothing", {})
    assert min(plain.values()) > nothing
    for said, meant in {"a s s": "ass", "a $ $": "ass", "i d ! o t": "idiot", "i  d\ti\no t": "idiot", "i d i o t,": "idiot", "i d i o t!": "idiot", "i d i o t !": "idiot", '"i d i o t"': "idiot", "$ t u p i d": "stupid", "h e y   i d i o t": "idiot", "s t u p 1 d.": "stupid"}.items():
        assert model.score(f"well {said}", {}) >= plain[meant], said
    assert model.score("1 or 2 x y zebra", {}) == nothing


def test_words_of_unlabelled_documents_count(spark):
    """Labelled documents hold a word only in disguise, the others say what it is."""
    ids = [k for k in range(600) if zlib.crc32(str(k).encode()) % 3 != 1]
    said = {k: f"here is s1lly text w{k}" if n < 40 else f"here is text w{k}" for n, k in enumerate(ids[:200])}
    docs = spark.createDataFrame([*said.items(), *[(1000 + k, "a silly old thing") for k in range(50)]], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int("s1lly" in t)) for k, t in said.items()], "doc_id long, toxic int")
    known = {r["token"]: r["meant"] for r in toxicity.decoded(toxicity.gathered(docs)).collect()}
    assert known["s1lly"] == "silly"
    scores = {r["doc_id"]: r["score"] for r in toxicity.predict(docs, labels).collect()}
    assert scores[1000] > 10 * max(scores[k] for k, t in said.items() if "s1lly" not in t)
    # A word counts from its first occurrence, and its trigrams with it.
    few = toxicity.Channel(Counter({"quiz": 1, "house": 100}))
    assert "quiz" in few.words and few.step("qu", "i") > few.unseen["qu"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.predict(docs, labels).join(labels, "doc_id").where("held_out").selectExpr("sum(predicted * toxic) AS hit", "sum(toxic) AS all", "sum(predicted) AS said").first()
    assert got["hit"] / got["said"] >= 0.9 and got["hit"] / got["all"] >= 0.8


def test_toxicity_edge_tables(spark):
    df = brute.documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] < 1e-6 for r in toxicity.predict(df, none).collect()} == {True}
    some = spark.createDataFrame([(0, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.predict(df, some).count() == df.count()
    assert toxicity.predict(brute.empty(spark), some).count() == 0


# Chat


def test_chat_round_trip(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "a\\", "<\\|", "\\\\<|", "", "line\nline", None, "end <", "é🎉"]
    turns = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(said)] + [(2, 0, None, "x"), (2, 0, None, "x"), (None, 1, "ro\nle<|", "y"), (3, None, "assistant", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit(5))
    got = {r["conv_id"]: r for r in chat.summary(chat.render(chat.fold(chat.turns_as_events(df)))).collect()}
    for conv in (1, 2, 3, None):
        mine = [(r or "", t or "") for c, _, r, t in turns if c == conv]
        loss = "".join(t for r, t in mine if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(mine), brute.sha("".join(f"{a}\n{b}\n" for a, b in mine)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), brute.sha(loss))
    rendered = chat.render(chat.fold(chat.turns_as_events(df))).where("conv_id = 1").first()
    spans = [rendered["formatted"][s["start"] : s["end"]] for s in rendered["loss_spans"]]
    assert [x.replace("<\\|", "<|").replace("\\\\", "\\") for x in spans] == [t or "" for k, t in enumerate(said) if k % 2]
    assert chat.summary(chat.render(chat.fold(chat.turns_as_events(df.limit(0))))).count() == 0


def test_folding_events(spark):
    events = [
        (1, 1, 1, "start", "user", None), (1, 1, 2, "delta", None, "Hel"), (1, 1, 3, "delta", None, "lo"), (1, 2, 4, "start", "assistant", None), (1, 2, 5, "delta", None, "bad"),
        (1, 3, 6, "start", "user", "why"), (1, 2, 7, "regenerate", None, None), (1, 2, 8, "delta", None, "good"), (1, 3, 9, "start", "user", None), (1, 3, 10, "delta", None, "ok"),
        (2, 1, 1, "start", "user", "typo"), (2, 1, 2, "edit", None, "fixed"), (2, 1, 3, "delta", None, "!"),
    ]
    df = spark.createDataFrame(events, "conv_id long, msg long, seq long, kind string, role string, text string")
    got = sorted((r["conv_id"], r["msg"], r["role"], r["text"]) for r in chat.fold(df).collect())
    assert got[:2] == [(1, 1, "user", "Hello"), (1, 2, "assistant", "good")] and got[-1] == (2, 1, "user", "fixed!")


# Shards


def test_shards(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id").withColumn("cell", F.lit(1))
    got = sharding.shard(df, "doc_id", 24).collect()
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    again = {r["doc_id"]: r["shard"] for r in sharding.shard(df, "doc_id", 24).collect()}
    assert again == {r["doc_id"]: r["shard"] for r in got}
    grown = {r["doc_id"]: r["shard"] for r in sharding.shard(df, "doc_id", 25).collect()}
    assert sum(grown[d] != s for d, s in again.items()) / len(again) < 0.12
    odd = spark.createDataFrame([(None,), (None,), (1,), (1,), (1,)], "doc_id long")
    assert sorted(Counter(r["shard"] for r in sharding.shard(odd, "doc_id", 2).collect()).values()) == [2, 3]
    assert sharding.shard(odd.limit(0), "doc_id", 24).count() == 0


def test_equal_keys_are_ranked_in_parts(spark):
    df = spark.range(3000).select((F.col("id") * 0 + 7).alias("doc_id"), F.col("id").alias("size"))
    got = sharding.shard(df, "doc_id", 5).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(5) for k in range(600)]


def test_query_of_shards(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op10_bounded_ring_sharding"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got} == {d: (len(t) + 8, zlib.crc32(t), "rows", None) for d, t in texts.items()}


# Names


INNER = "id first n key gone some ranges base hash t_id t_hash terms cell_ part_ n_ at_ first_ end_ slot_ rank_ before_ salt_ of_ home_ into_ _key _gone _some _ranges _base _hash _terms _id _cell _rank text_key anchor vertex node tail spans entity r_id m pivot".split()


@pytest.mark.parametrize("operator", ["sanitise", "remove", "representatives", "shard", "keep"])
def test_other_columns_keep_their_names_and_values(spark, operator):
    from tagframe.llm import jaccard, suffixes

    def added(df):
        return df.withColumns({n: F.concat(F.lit(n), F.lit(" of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in INNER})

    run = {"sanitise": pii.sanitise, "remove": suffixes.remove, "representatives": jaccard.representatives, "shard": lambda d: sharding.shard(d, "doc_id", 3), "keep": quality.keep}[operator]
    df = added(spark.createDataFrame(brute.odd_documents(), brute.SCHEMA))
    got = run(df)
    assert got.columns[: len(df.columns)] == df.columns
    kept = got.collect()
    assert kept and all(r[n] == f"{n} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in kept for n in INNER)


def test_plain_text_takes_the_short_ways(monkeypatch):
    import random

    rng = random.Random(7)
    odd = ["".join(rng.choice('ab1@ .!(_*\n\tàß²"x') for _ in range(rng.randint(1, 14))) for _ in range(5000)]
    for text in odd:
        assert bool(toxicity.SPACED(text)) <= bool(toxicity.LAST_TWO(text))
        for token in text.split():
            word = token.strip(toxicity.EDGES)
            assert toxicity.clean(token) == (word if word.isalpha() and not toxicity.disguised(word) else None)

    def never(x):
        raise AssertionError(x)

    monkeypatch.setattr(toxicity, "SPACED", never)
    monkeypatch.setattr(toxicity, "disguised", never)
    assert toxicity.spaced("this is a plain text, and i see no run in it") == set()
    assert toxicity.clean('"plain,') == "plain"
