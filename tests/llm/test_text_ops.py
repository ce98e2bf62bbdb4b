"""Operators on one document at a time: chat, language, secrets, token counts, packing."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import from_spark, from_sql, rows
from tests.llm import brute
from tidemark.llm import chat, language, packing, queries, secrets, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, key string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, None, 1, "x") for i, t in texts], DOCS)


def test_chat_equals_sql(spark, sf_dir):
    assert rows(from_spark(queries.op1_chat(spark, sf_dir))) == rows(from_sql(queries.oracle_sql()["op1_chat"], sf_dir))


def test_chat_cases(spark):
    turns = spark.createDataFrame([
        (1, 0, "system", "be kind", 1), (1, 1, "ann", "hi <|bob|>", 1), (1, 2, "bob", None, 1), (1, 2, None, "who", 1), (1, 300, "ann", "bye", 1), (1, 300, "ann", "bye", 1),
        (2, None, "ann", "lost", 1), (3, 0, "system", "alone", 1), (None, 0, "ann", "nowhere", 1),
    ], "conv_id long, turn long, role string, text string, participant int")
    got = {(r.conv_id, r.part, r.participant): r for r in chat.rotate_perspectives(turns).collect()}
    assert set(got) == {(1, 0, p) for p in ("ann", "bob", "unknown")} | {(1, 1, p) for p in ("ann", "bob", "unknown")} | {(2, -1, "ann"), (3, 0, None), (None, 0, "ann")}
    ann = got[1, 0, "ann"]
    assert ann.text == "<|system|>\nbe kind\n<|assistant|>\nhi < |bob|>\n<|user name=bob|>\n\n<|user name=unknown|>\nwho\n"
    assert [ann.text[s.start : s.end] for s in ann.spans] == ["hi < |bob|>"] and (ann.n_turns, ann.n_train) == (4, 1)
    late = got[1, 1, "ann"]
    assert late.text == "<|system|>\nbe kind\n<|assistant|>\nbye\n<|assistant|>\nbye\n"
    assert (late.n_turns, late.n_train) == (2, 2) and [late.text[s.start : s.end] for s in late.spans] == ["bye", "bye"]
    assert got[1, 0, "bob"].n_train == 1 and got[3, 0, None].spans == []
    assert chat.rotate_perspectives(turns.limit(0)).count() == 0


def test_chat_pieces(spark, tmp_path):
    """Turns without a number, of one number, and one turn many times over; also against the SQL."""
    said = [(1, None, "ann", f"n{i % 40}") for i in range(700)] + [(1, 3, "bob", "same")] * 600 + [(1, 0, "system", "s"), (2, 0, "system", "one"), (2, 0, "system", "two"), (2, 9, "cat", "x"), (2, 900, "cat", "y"), (None, 5, None, None), (None, 700, "dog", "<|")]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    turns.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = from_spark(queries.op1_chat(spark, str(tmp_path)))
    assert got.n_turns.max() <= 256 and got[(got.conv_id == 1) & (got.participant == "ann")].n_turns.sum() == 1301
    assert got[(got.conv_id == 2) & (got.part == 3)].text.tolist() == ["<|system|>\none\n<|system|>\ntwo\n<|assistant|>\ny\n"]
    sql = queries.oracle_sql()["op1_chat"].replace("FROM conversations", f"FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert rows(got) == rows(from_sql(sql, "/root/testdata/sf0.001"))


def test_chat_history(spark, tmp_path):
    """The turns before a part stand at its head, at most 32, and nobody is trained on them; also against the SQL."""
    said = [(1, i, "ann" if i % 2 else "bob", f"t{i}") for i in range(600)] + [(2, 255, "cat", f"x{i}") for i in range(50)] + [(2, 256, "dog", "y"), (3, 240, "ann", "gone"), (3, 900, "ann", "far"), (None, 250, "eve", None), (None, 260, "eve", "z")]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    turns.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = from_spark(queries.op1_chat(spark, str(tmp_path)))
    row = got[(got.conv_id == 1) & (got.part == 1) & (got.participant == "ann")].iloc[0]
    assert row.text.startswith("<|user name=bob|>\nt224\n<|assistant|>\nt225\n") and row.n_turns == 256 and row.n_train == 128
    assert row.text[int(row.spans.split(":")[0]) :].startswith("t257")
    assert got[(got.conv_id == 2) & (got.part == 1) & (got.participant == "dog")].text.iloc[0].count("<|user name=cat|>") == 32
    assert got[(got.conv_id == 3) & (got.part == 3)].text.tolist() == ["<|assistant|>\nfar\n"]
    sql = queries.oracle_sql()["op1_chat"].replace("FROM conversations", f"FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert rows(got) == rows(from_sql(sql, "/root/testdata/sf0.001"))


def test_token_counts_equal_the_library(spark, sf_dir):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    random.seed(1)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    odd = ["", " ", "  ", " a", "a ", "a  b", "\n", " \n a\n\nb ", "日本語 🎉", "\x00\t", "<s> </s> <0x0A>", "a" * 3000, "x▁y ▁"] + ["".join(random.choice("ab \n▁é🎉the") for _ in range(random.randint(1, 60))) for _ in range(400)]
    texts |= {10**6 + i: t for i, t in enumerate(odd)} | {10**7: None}
    counted = docs(spark, list(texts.items())).withColumn("n", token_counts.token_counter(public_tokenizers.path("piece_bpe_32k.model"))("text"))
    assert {r.doc_id: r.n for r in counted.collect()} == {i: len(model.encode(t or "")) for i, t in texts.items()}
    got = from_spark(queries.op7_token_counts(spark, sf_dir))
    assert set(got.columns) == {"doc_id", "n_bytes", "n_tokens", "over_limit"}


def test_token_counts_of_odd_tables(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op7_token_counts(spark, f"{tmp_path}/none").count() == 0
    docs(spark, [(None, "a"), (1, "a"), (1, "a"), (2, None), (3, "word " * 5000)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([tuple(r) for r in queries.op7_token_counts(spark, str(tmp_path)).collect()], key=str)
    assert [r[:2] for r in got] == [(1, 1), (1, 1), (2, 0), (3, 25_000), (None, 1)] and got[2][2:] == (0, False) and got[3][3] is True


def ids_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]


def test_packing(spark, sf_dir):
    import public_tokenizers

    random.seed(3)
    letters = list("abcXYZ .,!?'s\n\tÀéßÿªº²½İıΣς日本🎉́ \x1c\x85_-1") + ["<|endoftext|>", "don't"]
    texts = [(i, "".join(random.choice(letters) for _ in range(random.randint(0, 200)))) for i in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "word " * 9000), (1002, "word " * 9000), (None, "no name"), (2**60 + 1, "big")]
    got = from_spark(packing.pack(docs(spark, texts), public_tokenizers.path("word_bpe_49k.json")))
    ids = dict(zip([i for i, _ in texts], ids_of([t for _, t in texts]), strict=True))
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert got[got.doc_id == 1002].length.tolist().count(4096) == 4
    assert got.length.sum() == sum(len(ids[i]) for i, _ in texts)
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 4096
    assert packing.pack(docs(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def plain_packing(sizes, capacity, most):
    """(bin, offset) of each size by the rule, bins held in a list."""
    open_bins, out, made = [], [], 0
    for size in sizes:
        fits = [x for x in open_bins if x[0] >= size]
        if fits:
            best = min(x[0] for x in fits)
            own = [x for x in fits if x[0] == best][-1]
            open_bins.remove(own)
        else:
            if len(open_bins) == most:
                least = min(x[0] for x in open_bins)
                open_bins.remove([x for x in open_bins if x[0] == least][-1])
            own, made = (capacity, made), made + 1
        out.append((own[1], capacity - own[0]))
        if own[0] > size:
            open_bins.append((own[0] - size, own[1]))
    return out, {x[1] for x in open_bins}


def test_packing_follows_the_rule(spark):
    """More than 2,000 sequences of one task, each where a plain version of the rule puts it."""
    import public_tokenizers

    rng = random.Random(8)
    sizes = [min(4096, int(rng.paretovariate(0.9) * 60)) for _ in range(32_000)]
    lengths = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n int")
    table = lengths.coalesce(1).sortWithinPartitions("doc_id").select("doc_id", F.repeat(F.lit("the "), F.col("n") - 1).alias("text"))
    got = from_spark(packing.pack(table, public_tokenizers.path("word_bpe_49k.json")))
    got = got.astype({c: "int64" for c in got.columns}).set_index("doc_id").sort_index()
    assert got.length.tolist() == sizes
    want, still = plain_packing(sizes, 4096, packing.OPEN_BINS)
    closed = [i for i, (b, _) in enumerate(want) if b not in still]
    assert list(zip(got.sequence_id[closed], got.offset[closed], strict=True)) == [want[i] for i in closed]
    rest = sorted((i for i, (b, _) in enumerate(want) if b in still), key=lambda i: want[i])
    again, _ = plain_packing([sizes[i] for i in rest], 4096, packing.OPEN_BINS)
    assert list(zip(got.sequence_id[rest] - (1 << 62), got.offset[rest], strict=True)) == again
    assert len({b for b, _ in want}) > 2000 and len(rest) < 0.1 * len(sizes)


def test_packing_with_other_files(spark):
    """Files for which the fast ways do not hold are seen by the probes."""
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    folder = os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))
    text = "Hello World, don't   stop.\n\nÀ l'été 12 日本"
    for name in sorted(n for n in os.listdir(folder) if n.endswith(".json")):
        path = f"{folder}/{name}"
        try:
            library = Tokenizer.from_file(path)
        except Exception:  # other kinds of files
            continue
        assert packing.WordIds(path).encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), name


def test_packing_comes_near_the_least(spark, sf_dir):
    got = from_spark(queries.op8_packing(spark, sf_dir))
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 4096 + 1


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.add(n) for n in (6, 7, 3, 8, 2, 5)] == [(0, 0), (1, 0), (1, 7), (2, 0), (2, 8), (3, 0)]
    assert bins.n <= 2 and bins.open() == {0, 3}


def test_language(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = from_spark(queries.op3_language(spark, sf_dir)).merge(from_spark(table.select("doc_id", "lang")))
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.97 and got.score.between(0, 1).all()
    assert [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id] == got.held_out.tolist()
    assert got.rejected.mean() < 0.02


def test_language_cases(spark, sf_dir):
    model = language.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    long = "the thand of the " * 200_000
    cases = docs(spark, [(1, None), (2, ""), (3, "123 -- !!"), (4, "²½"), (5, long), (6, "the"), (7, "ñ")])
    got = {r.doc_id: r.p for r in cases.select("doc_id", language.predictor(model, spark)("text").alias("p")).collect()}
    assert all(got[i] == ("und", 0.0, True) for i in (1, 2, 3, 4))
    assert all(got[i].lang in model.languages for i in (5, 6, 7)) and got[5].lang == "en"
    assert np.allclose(model.means([long]), model.means([long[: 17 * 1000]]), atol=1e-3)
    none = language.train(cases.where("lang IS NULL"))
    assert cases.select(language.predictor(none, spark)("text").alias("p")).where("p.lang <> 'und'").count() == 0


def test_features_equal_a_plain_version():
    """Subwords counted by slices, and averages by a loop."""
    text = "Où  the Ñandú-theory, 12 ab\nx"
    data = b" " + bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode()) + b" "
    want = {}
    for size in language.SIZES:
        for i in range(len(data) - size + 1):
            part = data[i : i + size]
            if b" " in part[1:-1] or part == b"  ":
                continue
            key = part[0]
            for b in part[1:]:
                key = (key * 0x01000193 + b) & 0xFFFFFFFF
            bucket = (((key ^ (size * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF) >> 16
            want[bucket] = want.get(bucket, 0) + 1
    own, counts = language.features(text)
    assert dict(zip(own.tolist(), counts.tolist(), strict=True)) == want
    weights = np.random.default_rng(1).normal(size=(language.BUCKETS, 3)).astype(np.float32)
    model = language.Model(["a", "b"], weights, np.array([0.1, 0.2, 0.3]), 1.5)
    mean = sum(n * weights[b].astype(float) for b, n in want.items()) / sum(want.values())
    score = np.exp((mean + model.bias) / 1.5)
    assert np.allclose(model.means([text, None, text * 2])[0], mean) and np.allclose(model.probabilities([text])[0], (score / score.sum())[:2])


def test_language_rejects_what_it_never_learned(spark, sf_dir):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    model = language.train(table.where("lang <> 'de'"))
    rng = np.random.default_rng(9)
    of = lambda lang: [r.text for r in table.where(F.col("lang") == lang).orderBy("doc_id").limit(80).collect()]
    rejected = lambda texts: np.mean(model.scores(texts) < model.threshold)
    known = of("en") + of("fr")
    assert model.languages == ["en", "es", "fr"]
    assert rejected(of("de")) > 0.9 and rejected([language.counter_example(t, rng) for t in known]) > 0.95
    assert rejected(["Привет как дела мой друг и все такое", "日本語の文章です", "xkq zzqj qqq wvx jjq"]) == 1
    assert rejected(known) < 0.02 and rejected([a + " " + b for a, b in zip(of("en"), of("fr"), strict=False)]) < 0.05


def test_language_sample_is_bounded(spark):
    many = spark.range(3000).selectExpr("21 AS doc_id", "'the same text' AS text", "'en' AS lang")
    langs = spark.range(600).selectExpr("id AS doc_id", "concat('text of its own ', id) AS text", "concat('l', id) AS lang")
    rows_ = language.sample(many.unionByName(langs).unionByName(langs), 1200, 5)
    assert len(rows_) == 601 and len({lang for lang, _ in rows_}) == 601
    few = language.sample(spark.range(500).selectExpr("id AS doc_id", "concat('t ', id) AS text", "'en' AS lang"), 1200, 40)
    assert len(few) == 40
    assert language.train(langs.limit(40)).languages


def test_language_of_odd_rows(spark, tmp_path):
    table = docs(spark, [(None, "the and of"), (7, "the and of"), (7, "the and of"), (8, None)])
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = from_spark(queries.op3_language(spark, str(tmp_path)))
    assert len(got) == 4 and set(got.lang_pred) <= {"en", "und"}
    docs(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op3_language(spark, f"{tmp_path}/none").count() == 0


def test_secrets_keep_the_base(spark, sf_dir):
    got = from_spark(queries.op5_secrets(spark, sf_dir)).set_index("doc_id")
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        want = brute.base_spans(r.text)
        mine = got.loc[r.doc_id]
        assert mine.base_sha256 == brute.sha(",".join(want)) and mine.n_assign + mine.n_access + mine.n_hex == len(want)
        assert [s for s in mine.spans.split(",") if s and not s.startswith("model")] == want


@pytest.mark.parametrize("text", [None, "", "password=abc", "Token : 'abcdef' secret=token=abcdef", "x" * 10 + "AKIA" + "A" * 15, "AKIA" + "A" * 16, "f" * 23, "F" * 30, "API_KEY=\"" + "0" * 24, "ſecret=abcdef toKen=abcdef", "token:x password:abcdefg"])
def test_base_patterns(text):
    assert [f"{k}:{s}:{e}" for s, e, k in secrets.base_spans(text)] == brute.base_spans(text)


def values_of_unknown_kinds():
    random.seed(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    r = lambda n, a=letters: "".join(random.choice(a) for _ in range(n))
    kinds = [lambda: "ghp_" + r(36), lambda: "sk_live_" + r(24), lambda: r(64, letters + "+/"), lambda: f"postgres://svc:{r(16)}@db.example.com:5432/app", lambda: f"xoxb-{r(12, '0123456789')}-{r(24)}", lambda: r(32, "0123456789ABCDEF")]
    return [[k() for _ in range(40)] for k in kinds]


HARMLESS = ["mail6.example.com", "4736962573099581", "97.51.17.173", "https://www.example.com/path/to/page.html", "internationalization", "2024-01-01T00:00:00", "user_order_detail_window", "+49-171-1234567", "v1.2.3-beta.4", "1234-5678-9012-3456", "john.smith@mail.example.org"]


def harmless_kinds():
    """Kinds of values that are no secrets: cards, network addresses, identifiers in groups, bank accounts, words, names."""
    rng = random.Random(6)
    digits, hexes = (lambda n: "".join(rng.choice("0123456789") for _ in range(n))), (lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n)))
    kinds = [lambda: digits(16), lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: "-".join(hexes(n) for n in (8, 4, 4, 4, 12)), lambda: rng.choice(["DE", "GB", "FR"]) + digits(2) + rng.choice(["", "NWBK"]) + digits(16), lambda: rng.choice(["thanonontioniner.", "INTERNATIONALLY:", "Verantwortlichkeit", "getCustomerAddressById", "/usr/local/share/python/modules", "com.example.service.UserController"])]
    return [[k() for _ in range(60)] for k in kinds]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_network_finds_kinds_that_no_pattern_knows(spark, size):
    """Trained on the findings of the fixed patterns in the documents, whether these are none, a dozen or many; none of these kinds is among them."""
    docs_ = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    network = secrets.train(docs_)
    assert network.recall >= secrets.RECALL and network.precision >= secrets.PRECISION
    said = ["so the value {} is given", "{}", "see {} and go on", "x = {}\n"]
    hit = lambda v, i=0: [s for s in secrets.scan_text(said[i % 4].format(v), network) if s[2] == "model"] != []
    for values in values_of_unknown_kinds():
        assert np.mean([bool(secrets.base_spans(v)) or hit(v, i) for i, v in enumerate(values)]) >= 0.6
    assert [v for v in HARMLESS if hit(v)] == []
    for values in harmless_kinds():
        assert np.mean([hit(v, i) for i, v in enumerate(values)]) <= 0.05
    spans = docs_.select("text", F.explode(secrets.scanner(network, spark)("text")).alias("s")).where("s.kind = 'model'").collect()
    assert len(spans) <= docs_.count() / 2000  # of documents whose only secrets the patterns know


def test_without_precision_nothing_is_added():
    """Labels that nothing can tell apart: no threshold has the precision that is asked for."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2 * secrets.N_CLASSES, (400, 20))
    network = secrets.Network().fit(x, (rng.random(400) < 0.5).astype(float))
    assert network.precision < secrets.PRECISION and network.threshold > 1


def test_network_equals_a_plain_version():
    """The forward pass by loops over places, and the gradients by small differences."""
    rng = np.random.default_rng(2)
    network, x, y = secrets.Network(), rng.integers(0, 2 * secrets.N_CLASSES, (3, 20)), np.array([1.0, 0.0, 1.0])
    network.bias += rng.normal(0, 0.1, secrets.FILTERS).astype(np.float32)
    for name in ("embedding", "kernel", "bias", "out", "out_bias"):
        setattr(network, name, getattr(network, name).astype(np.float64))

    def plain(row):
        z = [np.maximum(sum(network.embedding[row[i + j]] @ network.kernel[j * secrets.EMBEDDING : (j + 1) * secrets.EMBEDDING] for j in range(secrets.WIDTH)) + network.bias, 0) for i in range(len(row) - secrets.WIDTH + 1)]
        return 1 / (1 + np.exp(-(np.concatenate([np.max(z, axis=0), np.mean(z, axis=0)]) @ network.out + network.out_bias[0])))

    assert np.allclose(network.score(x), [plain(r) for r in x])
    loss = lambda: -np.mean(y * np.log(network.score(x)) + (1 - y) * np.log(1 - network.score(x)))
    network.embedding[0] = 0
    grads = network._gradients(x, y, np.ones(3))
    for values, grad in zip((network.embedding, network.kernel, network.bias, network.out, network.out_bias), grads, strict=True):
        for at in [tuple(rng.integers(0, d) for d in values.shape) for _ in range(8)]:
            if values is network.embedding:
                at = (int(x[0, int(rng.integers(20))]) or 1, at[1])
            before, values[at] = values[at], values[at] + 1e-5
            up = loss()
            values[at] = before - 1e-5
            assert abs((up - loss()) / 2e-5 - grad[at]) < 1e-4
            values[at] = before


def test_secrets_of_odd_rows(spark, tmp_path):
    long = "z1" * 400  # longer than one view
    table = docs(spark, [(1, f"a {long} b"), (1, f"a {long} b"), (None, None), (2, "")])
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = from_spark(queries.op5_secrets(spark, str(tmp_path)))
    assert sorted(got.n_hex.tolist()) == [0, 0, 0, 0] and len(got) == 4
    assert len(secrets.views("", long, "")) > 10
    docs(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op5_secrets(spark, f"{tmp_path}/none").count() == 0


def test_network_learns_and_redacts(spark):
    random.seed(5)
    hexes = lambda n: "".join(random.choice("0123456789abcdef") for _ in range(n))
    plain = lambda: "".join(random.choice("ghijklmnop") for _ in range(18)) + str(random.randint(0, 9))
    table = docs(spark, [(i, f"some words password={hexes(20)} and {plain()} more") for i in range(150)])
    network = secrets.train(table)
    assert network is not None and network.recall >= secrets.RECALL
    spans = secrets.scanner(network, spark)
    cases = docs(spark, [(1, f"so {hexes(20)} it is"), (2, None), (3, ""), (4, "password=abcdefgh, AKIA" + "Z" * 16), (5, plain())])
    got = {r.doc_id: r for r in cases.select("doc_id", "text", secrets.redact("text", spans("text")).alias("clean"), spans("text").alias("spans")).collect()}
    assert got[4].clean == "[secret], [secret]" and got[2].clean is None and got[3].clean == "" and got[5].clean == got[5].text
    assert secrets.train(docs(spark, [])).precision >= secrets.PRECISION  # from made examples alone


def test_network_learns_from_every_document(spark):
    """All findings and candidates of all documents are examples, and all parts of the training have a share in the network and its threshold."""
    table = docs(spark, [(i, f"the token=abc{i:05d}def and candidate{i:06d}x") for i in range(4000)])
    examples = secrets.examples_of(table)
    assert {r.label: r["count"] for r in examples.groupBy("label").count().collect()} == {0: 4000, 1: 4000}
    parts = secrets.parts_of(examples, secrets.words_of(examples), 3)
    assert [r.part for r in parts.select("part").orderBy("part").collect()] == [0, 1, 2]
    shown = {bytes(v) for r in parts.collect() for v in np.frombuffer(r.x, np.uint8).reshape(-1, secrets.VIEW + 2 * secrets.CONTEXT)}
    assert all(bytes(v) in shown for r in examples.collect() for v in secrets.views(r.before, r.value, r.after).astype(np.uint8))
    network = secrets.fit_parts(parts, 3)
    assert network.examples >= 3 * 4 * secrets.SHOWN and network.recall >= secrets.RECALL
