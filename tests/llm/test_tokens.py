import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import mixing, pieces, tokens

NAMES = ("byte_bpe_50k", "byte_bpe_multi_50k")
REFERENCE = {n: tiktoken.Encoding(n, pat_str=tokens.WORDS, mergeable_ranks=tokens.read_ranks(n), special_tokens={}) for n in NAMES}
ENCODERS = {n: tokens.Encoder((n,)) for n in NAMES}
ODD = ["", " ", "\n\n", "a", "<|endoftext|>", "it's  we're", "数据，，“x”。  y", "\x00a", "a\x1cb", "🙂🙂 é́", "x" * 5000, "１２３ ½²", ". \n . ,,x", "、 \n，a"]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(blacklist_categories=("Cs",)), st.sampled_from(" \n。，.,!aé数'"))))
def test_any_text(name, text):
    assert ENCODERS[name].batch([text])[0][0].tolist() == REFERENCE[name].encode_ordinary(text)


def test_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([*ODD, None])], "doc_id bigint, text string")
    both = docs.unionByName(odd)
    text = {r["doc_id"]: r["text"] for r in both.collect()}
    hf = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    hf.encode_special_tokens = True
    got = tokens.encode(both).collect()
    assert len(got) == len(text)
    for r in got:
        assert r["ids"] == hf.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
    assert tokens.encode(docs.limit(0)).count() == 0


PLANS = "mix_name string, tokenizer string, size_factor double"
TARGETS = "mix_name string, source string, target_weight double, max_repeats int"


def queue(docs, weights, repeats, budget):
    """Weighted fair queueing by brute force over (source, doc_id, tokens, order)."""
    finish = []
    for s, w in weights.items():
        rows = sorted((u, d, n) for x, d, n, u in docs if x == s)
        total, cum = sum(n for *_, n in rows), 0
        for _, d, n in rows:
            cum += n
            finish += [((k * total + cum) / w, s, d, k, n) for k in range(repeats[s])]
    out, used = set(), 0
    for f, s, d, k, n in sorted(finish):
        used += n
        if used > budget:
            break
        out.add((d, k))
    return out


def test_mixture_is_fair_queueing(spark):
    from pyspark.sql import functions as F

    texts = [(i, ["a", "b", "c", None, "out"][i % 5], "word " * (i % 7 + 1)) for i in range(200)] + [(900, "a", None), (901, "a", "")]
    docs = spark.createDataFrame(texts, "doc_id bigint, source string, text string")
    plans = spark.createDataFrame([("m", NAMES[0], 0.7), ("empty", NAMES[0], 1.0)], PLANS)
    targets = spark.createDataFrame([("m", "a", 3.0, 2), ("m", "b", 1.0, 1), ("m", "c", 1.0, 4), ("m", "none", 5.0, 2), ("empty", "none", 1.0, 1), ("m", "out", 0.0, 3)], TARGETS)
    order = {r["doc_id"]: r["u"] for r in docs.select("doc_id", F.xxhash64(F.lit("m"), "doc_id").alias("u")).collect()}
    sized = [(s, i, len(REFERENCE[NAMES[0]].encode_ordinary(t)), order[i]) for i, s, t in texts if t and s in ("a", "b", "c")]
    got = mixing.mixture(docs, plans, targets)
    want = queue(sized, {"a": 3.0, "b": 1.0, "c": 1.0}, {"a": 2, "b": 1, "c": 4}, 0.7 * sum(n for _, _, n, _ in sized))
    assert {(r["doc_id"], r["copy"]) for r in got.collect()} == want
    old, mixing.BUCKET_ROWS = mixing.BUCKET_ROWS, 5  # many buckets give the same mixture
    try:
        assert {(r["doc_id"], r["copy"]) for r in mixing.mixture(docs, plans, targets).collect()} == want
    finally:
        mixing.BUCKET_ROWS = old
    report = {(r["mix_name"], r["source"]): r for r in mixing.shares(got, targets).collect()}
    assert report["m", "none"]["tokens"] == 0 and report["m", "a"]["most_repeats"] <= 2 and report["empty", "none"]["reached_share"] == 0
    assert abs(report["m", "a"]["wanted_share"] - 0.3) < 1e-9
    assert mixing.mixture(docs.limit(0), plans, targets).count() == 0


PROFILES = "profile string, tokenizer string, max_tokens int, overlap_tokens int"


def test_pieces(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    odd = [(10**6, "数" * 4000), (10**6 + 1, "🙂" * 900), (10**6 + 2, None), (10**6 + 3, ""), (10**6 + 4, "a" * 9000), (10**6 + 5, ("line\n" * 30 + "\n") * 40), (10**6 + 6, " " * 4000)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"))
    profiles = [("p", NAMES[0], 256, 32), ("q", NAMES[1], 100, 0), ("r", NAMES[1], 10, 5), ("s", NAMES[0], 4, 3), ("t", NAMES[0], 9, 1)]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = pieces.split(docs, spark.createDataFrame(profiles, PROFILES)).toPandas().sort_values(["profile", "doc_id", "piece_no"])
    big = {(p, i) for p, n, most, lap in profiles for i, t in text.items() if t and len(REFERENCE[n].encode_ordinary(t)) > most}
    assert set(zip(got["profile"], got["doc_id"])) == big
    for (p, i), g in got.groupby(["profile", "doc_id"]):
        _, n, most, lap = next(x for x in profiles if x[0] == p)
        assert g["char_start"].iloc[0] == 0 and g["char_end"].iloc[-1] == len(text[i])
        ends = [0, *g["char_end"]]
        for r, before in zip(g.itertuples(), ends):
            assert r.piece == text[i][r.char_start : r.char_end] and r.char_start <= before < r.char_end
            assert r.n_tokens <= most and len(REFERENCE[n].encode_ordinary(r.piece)) <= most
            if lap == 0:
                assert r.char_start == before
        assert lap == 0 or most < lap + 2 * pieces.SPARE or (g["char_start"].to_numpy()[1:] < g["char_end"].to_numpy()[:-1]).all()
    paragraphs = got[(got["doc_id"] == 10**6 + 5) & (got["profile"] == "p")]
    assert all(x.endswith("\n\n") for x in paragraphs["piece"][:-1])
    assert pieces.split(docs.limit(0), spark.createDataFrame(profiles, PROFILES)).count() == 0
    assert pieces.split(docs, spark.createDataFrame([], PROFILES)).count() == 0

    for most, lap in ((3, 0), (10, 10)):
        with pytest.raises(ValueError):
            pieces.split(docs, spark.createDataFrame([("x", NAMES[0], most, lap)], PROFILES))


def test_texts_are_cut_once_a_profile(spark):
    """What the pattern takes is held, not looked for anew wherever it is used."""
    documents = spark.createDataFrame([(1, "数据局每年安排。" * 40)], "doc_id bigint, text string")
    profiles = spark.createDataFrame([("a", "byte_bpe_50k", 64, 8), ("b", "byte_bpe_50k", 32, 0)], "profile string, tokenizer string, max_tokens int, overlap_tokens int")
    out = pieces.split(documents, profiles)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
    got = out.filter("profile = 'b'").orderBy("piece_no").collect()
    assert "".join(r["piece"] for r in got) == "数据局每年安排。" * 40 and all(0 < r["n_tokens"] <= 32 for r in got)


def test_words_by_ranges():
    """Texts of the first plane are parted by plain ranges, into the same words as by the classes."""
    import random

    rng = random.Random(7)
    plane = "".join(map(chr, range(0x10000)))
    assert tokens._PLAIN_WORDS.findall(plane) == tokens._WORDS.findall(plane) == tokens.words_of(plane)
    for _ in range(2000):
        text = "".join(rng.choice([rng.choice(plane), rng.choice(" \n\t 'sdlmrevt.,09１中aé\x1c\x85　🙂𝐀")]) for _ in range(40))
        assert tokens.words_of(text) == tokens._WORDS.findall(text)


def test_places_of_many_texts():
    """Texts worked out together have the places and letters that each has alone."""
    texts = ["。", "a. b", "", "🙂\x00 数", "x。", " y\n", "\n\nz\r\n\r\n", "\ud800é", "\n"]
    letters, place, begins = pieces.places(texts)
    for text, begin in zip(texts, begins):
        data = text.encode("utf-8", "replace")
        want = [(len(text[:i].encode("utf-8", "replace")) << 32) + i for i in range(1, len(text) + 1)]
        got = place[begin + 1 : begin + len(data) + 1]
        assert got[got >= 0].tolist() == want
        alone = pieces.boundaries(text).tobytes().decode()
        assert letters[begin + 1 : begin + len(data) + 1][got >= 0].tobytes().decode() == alone
        assert (letters[begin + 1 : begin + len(data) + 1][got < 0] == ord("b")).all() and alone[-1:] in ("p", "")


def test_takes_of_the_pattern():
    """A strong boundary is taken in the second half of the room, the last and strongest there."""
    import re

    takes = lambda shape: re.findall(pieces.pattern(8), shape)
    assert takes("xxxxxsxcxxxx") == ["xxxxxs", "xcxxxx"] and takes("xpxxxwxxxxxxxp") == ["xpxxxw", "xxxxxxxp"]
    assert takes("x" * 8) == ["x" * 8] and takes("b" * 10) == ["b" * 8, "bb"] and takes("bbxbbbbbbbbx") == ["bbx", "bbbbbbbb", "x"]
    assert pieces.pattern(8).count(".{4}") == 1
