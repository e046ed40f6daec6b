"""The text operators against brute force on small fixtures, with nulls, empty and long texts, repeats and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlattice.llm import bpe, decontaminate, html_extract, line_dedup, minhash, pii, quality, suffix_dedup, token_output, toxicity
from runlattice.llm import components as graph
from runlattice.llm.common import dropped, stored
from runlattice.llm.queries import tokenizer_path

WORDS = ["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "Über", "naïve", "x1"]


def sentence(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", ".", "%"]) for _ in range(n))


def fixture_rows():
    r = random.Random(7)
    base = [sentence(r, 60) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(12, 40):
        w = r.choice(base).split()
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"new{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    shared = sentence(r, 40)
    rows += [(40 + i, sentence(r, 20) + "\n" + shared + "\n" + sentence(r, 20)) for i in range(6)]
    rows += [(50, None), (51, ""), (52, " \n\t "), (53, "one"), (54, "two words"), (55, "a " * 9000), (56, "a " * 9000), (57, shared), (58, "Ein Satz mit\x1cZeichen 😀 und <|endoftext|> am Ende."), (59, "x" * 5000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 1, "z") for i, t in fixture_rows()], "doc_id bigint, text string, lang string, weight int, bands string").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("false")


def texts():
    return {i: t or "" for i, t in fixture_rows()}


# -- MinHash


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("few,small", [(8, 64), (0, 2)])
def test_minhash(docs, nothing, monkeypatch, few, small):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "SMALL", small)
    sets = {d: shingles(t, 4) for d, t in texts().items()}
    want = components(sets)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == {d: (len(s), want[d], want[d] == d) for d, s in sets.items()}
    if small == 64:
        assert minhash.near_duplicates(nothing).count() == 0
        kept = minhash.deduplicated(docs, k=4)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d in want if want[d] == d}


def test_minhash_repeated_and_null_ids(spark):
    t = " ".join(f"Word{i}" for i in range(30))
    df = spark.createDataFrame([(1, t), (1, t), (2, t.upper()), (None, t), (3, None)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert [g for g in got if g[0] > 0] == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]


@pytest.mark.parametrize("few,small", [(0, 64), (0, 3)])
def test_hot_group_without_all_pairs(spark, monkeypatch, few, small):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "EDGES", 16)
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(60)] = f"q{r.randrange(400)}"
        rows.append((i, " ".join(w[: r.randrange(35, 61)] if i % 3 == 0 else w)))
    want = components({i: shingles(t, 4) for i, t in rows})
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_documents_with_a_passage_in_common_seldom_meet(spark, monkeypatch):
    """Thirty of seventy shingles are shared by all: a similarity of 0.27, which bands of four coordinates bring together in 1 of 5 pairs."""
    compared = []
    real = minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda edges, *rest: (compared.append(edges.count()), real(edges, *rest))[1])
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(33))
    rows = [(i, passage + " " + " ".join(f"w{r.randrange(10**9)}" for _ in range(37))) for i in range(300)]
    rows += [(300 + i, t + " end") for i, t in rows[:5]]
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i - 300 if i >= 300 else i for i, _ in rows}
    assert sum(compared) < len(rows)


def test_rounds_grow_as_the_logarithm_of_a_group(spark, monkeypatch):
    """Copies of one text with three of eight edits in two wordings, most of them not linked: differences from most copies halve the groups, whatever the pivot."""
    monkeypatch.setattr(minhash, "FEW", 0)
    monkeypatch.setattr(minhash, "SMALL", 3)
    rounds = []
    real = minhash.verified

    def counted(*a):
        rounds.append(1)
        assert len(rounds) <= 2 * (2 + 5)  # two comparisons a round; after the first one, 90 halved until 3 are left
        return real(*a)

    monkeypatch.setattr(minhash, "verified", counted)
    r = random.Random(7)
    base = [f"w{i}" for i in range(73)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in r.sample(range(4, 72, 8), 3):
            w[at] = f"q{at}-{r.randrange(2)}"
        rows.append((i, " ".join(w)))
    want = components({i: shingles(t, 4) for i, t in rows})
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and len(set(want.values())) > 5


def test_parities_never_differ_more_than_sets():
    r = np.random.default_rng(8)
    apart = []
    for n, changed in [(1, 1), (83, 10), (83, 30), (5000, 900)]:
        x = np.sort(r.integers(0, 2**63, n).astype(np.uint64))
        y = np.sort(np.concatenate([x[changed:], r.integers(0, 2**63, changed).astype(np.uint64)]))
        bits = sum(int(a ^ b).bit_count() for a, b in zip(minhash.parities(x).view(np.uint64).tolist(), minhash.parities(y).view(np.uint64).tolist()))
        assert bits <= len(np.setxor1d(x, y))
        apart.append(bits)
    assert minhash.PARITIES == len(minhash.parities(np.empty(0, np.uint64))) and apart[2] > 50


def test_components_on_driver_and_in_rounds(spark, monkeypatch):
    r = random.Random(6)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7)]
    parent = list(range(200))
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    want = {i: p for i, p in enumerate(parent) if p != i}
    edges = spark.createDataFrame(links, "a bigint, b bigint")
    for most in (1000, 10):
        monkeypatch.setattr(graph, "DRIVER_LINKS", most)
        assert {x["node"]: x["root"] for x in graph.components(edges).collect()} == want


def shuffle_bytes(spark):
    import pathlib

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(p.stat().st_size for d in manager.localDirsString() for p in pathlib.Path(d).rglob("shuffle_*.data"))


def test_stored_tables_leave_no_shuffle_files(spark):
    before = shuffle_bytes(spark)
    table = stored(spark.range(100_000).withColumn("x", F.sha2(F.col("id").cast("string"), 256)).repartition(5, "x"), "t")
    assert table.count() == 100_000 and shuffle_bytes(spark) - before < 1_000_000
    dropped(table)


# -- pseudonyms


def test_feistel_permutes():
    f = pii.Feistel(b"k")
    for size in (1, 2, 7, 100, 1000):
        assert sorted(f.permute(i, size, b"t") for i in range(size)) == list(range(size))


def test_pii(spark, nothing):
    t = "Mail anna.b7@mail3.example.com or +1 (743) 555-3824, card 4111 1111 1111 1111, ip 70.23.22.57, born 29.02.2000, not 31.02.2000, iban DE89 3704 0044 0532 0130 00, ssn 219-09-9999, token = \"%s\", v2.0." % ("ab12" * 10)
    df = spark.createDataFrame([(1, t), (2, t), (3, None), (4, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymised(df, b"k").collect()}
    assert got[1]["text"] == got[2]["text"] and got[3]["text"] is None and got[4]["text"] == ""
    new = got[1]["text"]
    for value in ("anna.b7@", "555-3824", "4111 1111 1111 1111", "70.23.22.57", "29.02.2000", "3704 0044", "219-09-9999", "ab12ab12"):
        assert value not in new
    assert "31.02.2000" in new and "v2.0." in new and "@mail3.example.com" in new
    number = re.search(r"card ([\d ]+),", new)[1].replace(" ", "")
    assert pii.luhn_digit(number[:-1]) == number[-1]
    assert re.sub(r"[0-9a-z]", "#", new.split("born")[0].split("or +")[1]) == re.sub(r"[0-9a-z]", "#", t.split("born")[0].split("or +")[1]) or "." in new
    assert [got[1][f"n_{k}"] for k in pii.KINDS] == [1] * 8 + [0] and got[1]["n_replaced"] == 8
    assert pii.pseudonymised(nothing, b"k").count() == 0


def test_pii_links_spellings_and_keeps_formats():
    m = pii.Masker(b"k")
    digits = lambda t: re.sub("[^0-9]", "", m.text(t)[0])
    assert digits("743-555-3824") == digits("(743) 555-3824") == digits("+1 743-555-3824")[1:]
    for t in ("+49 30 1234567", "+33 1 23 45 67 89", "+34 612 345 678", "+44 (20) 7946 0958"):
        new, counts = m.text(f"call {t} now")
        assert new != f"call {t} now" and counts[pii.KINDS.index("phone")] == 1 and re.sub("[0-9]", "#", new) == re.sub("[0-9]", "#", f"call {t} now")
        assert new.split()[1] == t.split()[0]
    assert m.text("2001:db8::1 up")[0] == m.text("2001:0db8:0:0:0:0:0:1 up")[0] != "2001:db8::1 up"
    assert m.text("at 12:30:45, ::1 and std::vector")[0] == "at 12:30:45, ::1 and std::vector"


def test_pii_against_a_scan_without_the_prefilter(spark):
    """Every text of random values in random surroundings, found with the patterns alone."""
    r = random.Random(5)
    kinds = [lambda: f"{r.randrange(1, 13)}/{r.randrange(1, 29)}/{r.randrange(1900, 2099)}", lambda: ".".join(str(r.randrange(1, 255)) for _ in range(4)), lambda: f"{r.randrange(200, 999)}-{r.randrange(100, 999)}-{r.randrange(1000, 9999)}", lambda: f"+{r.choice([49, 33, 34, 352])} {r.randrange(10, 999)} {r.randrange(10**5, 10**7)}", lambda: f"a{r.randrange(99)}@b.co", lambda: f"2001:db8::{r.randrange(1, 9999):x}", lambda: f"{r.randrange(1, 899):03d}-{r.randrange(1, 99):02d}-{r.randrange(1, 9999):04d}", lambda: str(r.randrange(10**12, 10**19)), lambda: "%032x" % r.getrandbits(128), lambda: "AKIA" + "".join(r.choices("ABC123", k=16)), lambda: sentence(r, 2)]
    rows = [(i, " ".join(r.choice(kinds)() + r.choice(["", ".", ",", ")"]) for _ in range(r.randrange(0, 4)))) for i in range(600)] + [(7, None), (7, "")]
    m = pii.Masker(b"k")
    plain = lambda t: None if t is None else pii.ANY.sub(lambda x: m.value(x.lastgroup, x[0]) or x[0], t)
    got = pii.pseudonymised(spark.createDataFrame(rows, "doc_id bigint, text string"), b"k")
    assert sorted((x["doc_id"], x["text"] or "") for x in got.collect()) == sorted((i, plain(t) or "") for i, t in rows)


def test_pii_of_each_kind_alone_in_its_shortest_form():
    shortest = [("email", "a@b.co"), ("phone", "234 555 3824"), ("card", "4111111111119"), ("ip", "8.8.8.8"), ("ip", "10.0.0.1"), ("date", "1.2.2000"), ("date", "2000-1-2"), ("ssn", "219-09-9999"), ("iban", "NO9386011117947"), ("secret", "ab12" * 8), ("secret", "sk-" + "a1" * 8), ("secret", "AKIA" + "A1" * 8)]
    for kind, value in shortest:
        assert dict(zip(pii.KINDS, pii.Masker(b"k").text(f"at {value} it")[1]))[kind] == 1, value


# -- token output, BPE


def test_token_files(docs, nothing):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in token_output.written_index(docs, tokenizer_path("word_bpe_49k.json")).collect()}
    start = 0
    for d, t in sorted(texts().items()):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_output.written_index(nothing, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_token_files_have_indexes_that_prune(spark, tmp_path):
    """Row indexes, Bloom filters on doc_id and run-length encoding are in the files; lookups read single row groups; stripes are read apart."""
    r = random.Random(11)
    df = spark.createDataFrame([(3 * i, sentence(r, 40)) for i in range(6000)], "doc_id bigint, text string").repartition(1)
    out = f"file://{tmp_path}/tokens"
    options = token_output.ORC_OPTIONS | {"orc.stripe.size": "100000", "orc.stripe.row.count": "2000"}
    old, token_output.ORC_OPTIONS = token_output.ORC_OPTIONS, options
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        token_output.write_tokens(df, out, tokenizer_path("word_bpe_49k.json"))
    finally:
        token_output.ORC_OPTIONS = old
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = sorted(tmp_path.glob("tokens/*.orc"))
    stripes = 0
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        stripes += reader.getStripes().size()
        assert reader.getRowIndexStride() == 1000
        footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
        kinds = {(s.getColumn(), str(s.getKind())) for s in footer.getStreamsList()}
        assert (1, "ROW_INDEX") in kinds and (1, "BLOOM_FILTER_UTF8") in kinds
        assert all(str(footer.getColumns(i).getKind()) == "DIRECT_V2" for i in (1, 2, 3))
    assert stripes > len(files)

    def rows_read(condition):
        got = token_output.read_tokens(spark, out).filter(condition)
        n = len(got.collect())
        return n, got._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    assert rows_read("doc_id >= 0") == (6000, 6000)
    n, read = rows_read("doc_id = 9000")
    assert n == 1 and read <= 1000
    n, read = rows_read("doc_id = 9001")  # within the minima and maxima; only the Bloom filter rules it out
    assert n == 0 and read == 0
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        assert token_output.read_tokens(spark, out).rdd.getNumPartitions() > len(files)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")



def test_token_files_prune_by_id(spark, docs, tmp_path):
    token_output.write_tokens(docs, str(tmp_path / "t"), tokenizer_path("word_bpe_49k.json"))
    assert token_output.read_tokens(spark, str(tmp_path / "t")).filter("doc_id = 53").count() == 1


def odd_words(r, n):
    letters = "abcdefgXYZÀÖØÞßàöøÿ"
    other = ["'s", "don't", "x1", "12", "a\tb", "\x1c", "é", "e\u0301", "İ", "Ÿ", "ſ", "ª", "日本語", "😀", "<|endoftext|>", "a<|startoftext|>b", "<|", "|>", "a--b", "(c)", "\u00a0", "\u0338", "=\u0338", "", "\x00"]
    return [r.choice(other) if r.random() < 0.2 else "".join(r.choices(letters, k=r.choice([1, 2, 3, 9]))) + r.choice(["", "", ".", "...", "$$$", "?!", "%*#&", ",\u0301"]) for _ in range(n)]


def test_word_encoder_against_whole_texts(monkeypatch):
    """Ids of odd words are those of the library for the whole text, also while words are forgotten."""
    import pyarrow as pa

    monkeypatch.setattr(token_output, "MEMO", 300)
    monkeypatch.setattr(token_output, "LONG", 8)
    r = random.Random(3)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = token_output.WordEncoder(tokenizer_path(name))
        for n in (0, 1, 5, 60, 60, 60, 60):
            some = [None, "", " ", "\n", *(r.choice([" ", "\n", "  "]).join(odd_words(r, r.randrange(20))) for _ in range(n)), "y" * 3000][-n - 2 :]
            ids, ends = enc.encode(pa.array(some, pa.string()).slice(1))
            want = [enc.lib.encode(t or "", add_special_tokens=False).ids for t in some[1:]]
            assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


def test_word_encoder_keeps_frequent_words(monkeypatch):
    """The library sees a frequent word once, although there are more words than are remembered."""
    import pyarrow as pa

    class Counted:
        def __init__(self, lib):
            self.lib = lib

        def encode_batch_fast(self, given, **options):
            for t in given:
                seen.update(t.split(" "))
            return self.lib.encode_batch_fast(given, **options)

    monkeypatch.setattr(token_output, "MEMO", 200)
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=9))
    frequent, seen = [word() for _ in range(50)], collections.Counter()
    enc = token_output.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    for name, lib in list(vars(enc).items()):
        if hasattr(lib, "encode_batch_fast"):
            setattr(enc, name, Counted(lib))
    for _ in range(30):
        enc.encode(pa.array([" ".join(frequent), " ".join(word() + "." for _ in range(60))]))
    assert all(seen[w] == 1 for w in frequent)
    assert len(seen) > 1500


def test_token_files_of_another_vocabulary(spark, docs, tmp_path):
    """A vocabulary whose tokens hold blanks gets whole texts."""
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    token_output.write_tokens(docs, str(tmp_path / "b"), path)
    lib = Tokenizer.from_file(path)
    got = {x["doc_id"]: x["ids"] for x in token_output.read_tokens(spark, str(tmp_path / "b")).collect()}
    assert got == {d: [*lib.encode(t, add_special_tokens=False).ids, 1] for d, t in texts().items()}


def test_parts_of_batches(monkeypatch):
    """Rows stay in order and whole; a part has PART_BYTES of text or a single row."""
    import pyarrow as pa

    monkeypatch.setattr(token_output, "PART_BYTES", 10)
    some = ["a" * 4, None, "b" * 6, "", "c" * 30, "d", "e" * 9, "", "f" * 11, "g"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(x)), pa.int64()), pa.array(x, pa.string())], ["doc_id", "text"]) for x in (some[:2], [], some[2:9], some[9:])]
    got = [p.column(1).to_pylist() for p in token_output.parts(batches)]
    assert sum(got, []) == some
    assert all(sum(len(t or "") for t in p) <= 10 or sum(bool(t) for t in p) == 1 for p in got)
    assert list(token_output.parts(batches[1:2])) == []


def test_bpe(docs, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(docs, path).collect()}
    for d, t in texts().items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    both = bpe.decode_column(bpe.encode_column(docs, path), path).select("text", "decoded").collect()
    assert all((r["text"] or "") == r["decoded"] for r in both)
    assert bpe.encode_column(nothing, path).count() == 0


def test_bpe_odd_characters():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib, own, r = Tokenizer.from_file(path), bpe.ByteBpe(path), random.Random(5)
    pool = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'ll", "<|endoftext|>", "é", "é", "漢字", "123", "½", "🙂", "\r\n", "...", "　"]
    for _ in range(3000):
        t = "".join(r.choice(pool) if r.random() < 0.6 else chr(r.choice([r.randrange(32, 0x250), r.randrange(0x250, 0xD800), r.randrange(0xE000, 0x20000)])) for _ in range(r.randrange(0, 14)))
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids
    long = "ab" * 3000
    assert own.word_ids(long.encode()) == lib.encode(long, add_special_tokens=False).ids


# -- suffixes


def removed(rows):
    seen, out = set(), {}
    for d, t in sorted(rows.items()):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("piece", [1 << 20, 700])
def test_suffixes(docs, nothing, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicated(docs).collect()}
    assert got == removed(texts())
    if piece > 1000:
        assert suffix_dedup.deduplicated(nothing).count() == 0


# -- pages


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script></head><body><header><a href="/">Home</a></header>
    <nav><ul><li><a href="/a">Menu one</a></ul></nav><div class="cookie-notice">We use cookies on this site.</div><div class="ad">Buy now, very cheap today.</div>
    <article><h1>Heading &amp; more</h1><p>First   paragraph with <b>bold</b> words and&nbsp;more of them.<p>Second paragraph, not closed, with enough words to count.
    <form><input><p>Your name please in this form field</p></form><p>Third one.</p><div class="comments"><p>I think that this reader comment is quite long indeed.</p></div></article>
    <aside><p>Read also these other things of ours.</p></aside><footer>&copy; someone, all rights.</footer></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>broken <a href='x"), (5, "x", "<nav>" * 3)]
    got = {r["page_id"]: r for r in html_extract.report(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1]["text"] == "Heading & more\nFirst paragraph with bold words and more of them.\nSecond paragraph, not closed, with enough words to count.\nThird one."
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == got[5]["text"] == ""


def test_minimum_cut_is_least():
    r = random.Random(2)
    for _ in range(60):
        n = r.randrange(1, 8)
        s, t = [r.random() for _ in range(n)], [r.random() for _ in range(n)]
        edges = [(i, j, r.random(), r.random()) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
        cost = lambda x: sum(t[i] if x[i] else s[i] for i in range(n)) + sum((f if x[a] else g) for a, b, f, g in edges if x[a] != x[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_extract.cut(s, t, edges)) - best) < 1e-6


def test_labels_of_pages_are_least_cuts(spark):
    """Labels against all labellings of blocks and elements; the cut overrules prices of blocks."""
    r = random.Random(8)
    shapes = ["<p>{}</p>", "<div class='ad'>{}</div>", "<li><a href='/'>{}</a></li>", "<article><p>{}</p></article>", "<nav>{}</nav>", "<h2>{}</h2>"]
    overruled, rows = 0, []
    for i in range(40):
        page = "".join(r.choice(shapes).format(sentence(r, r.randrange(1, 40))) for _ in range(r.randrange(1, 6)))
        page = f"<article>{page}</article>" if r.random() < 0.5 else page
        blocks, holders = html_extract.blocks_of(page)
        prices = [html_extract.odds(b) for b in blocks] + [html_extract.KIND * h.price for h in holders]
        edges, n = html_extract.smoothness(blocks, holders), len(prices)
        cost = lambda x: sum(max(-p, 0) if x[j] else max(p, 0) for j, p in enumerate(prices)) + sum((f if x[a] else g) for a, b, f, g in edges if x[a] != x[b])
        best = min(cost([bool(m >> j & 1) for j in range(n)]) for m in range(1 << n))
        got = html_extract.labelled(page)
        some = [content for _, _, content in got]
        assert abs(min(cost(some + [bool(m >> j & 1) for j in range(len(holders))]) for m in range(1 << len(holders))) - best) < 1e-6
        overruled += sum((p > 0) != content for _, p, content in got)
        rows += [(i, "u", page)] * (1 + i % 2)
    assert overruled
    out = html_extract.report(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert sorted((x["page_id"], x["text"]) for x in out.collect()) == sorted((i, html_extract.main_text(p)) for i, _, p in rows)
    assert html_extract.report(out.selectExpr("page_id", "url", "text AS html").filter("false")).count() == 0


# -- quality


def test_quality(docs, nothing):
    got = {r["doc_id"]: r for r in quality.judged(quality.ledger(docs)).collect()}
    for d, t in texts().items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count = collections.Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got[d]["n_words"], got[d]["word_chars"], got[d]["n_symbols"], got[d]["n_dup_lines"], got[d]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert got[d]["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (got[d]["base_failed"] and got[d]["kept"])
    assert quality.judged(quality.ledger(nothing)).count() == 0
    table = {r["rule"]: r for r in quality.ablations(quality.ledger(docs)).collect()}
    assert table["few_words"]["n_failed"] == sum(r["failed"] & 1 for r in got.values())


# -- decontamination


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_decontamination(spark, docs, nothing, limit):
    t = texts()
    items = [(0, " ".join(t[57].split()[:30])), (1, t[53]), (2, None), (3, ""), (4, " ".join(t[0].split()[10:40]) + " q w e r"), (5, "nothing of this is anywhere in here")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = set()
    for d, x in t.items():
        for i, y in items:
            n = min(5, len((y or "").split()))
            own, other = shingles(y or "", 5), {s for s in shingles(x, n) if len(s) == n} if n else set()
            if own and 5 * len(own & other) >= 4 * len(own):
                want.add((d, i, len(own), len(own & other)))
    got = decontaminate.contained(docs, bench, broadcast_shingles=limit)
    assert {tuple(r) for r in got.select("doc_id", "item_id", "n_item_shingles", "n_shared").collect()} == want and want
    kept = decontaminate.decontaminated(docs, bench, broadcast_shingles=limit)
    assert kept.columns == docs.columns
    assert decontaminate.contained(nothing, bench).count() == 0 and decontaminate.contained(docs, bench.filter("false")).count() == 0


def test_decontamination_by_shuffle_gives_the_rows_of_the_scan(spark):
    long = "a b c d e f g h i j k l m n"
    docs = spark.createDataFrame([(1, "x " + long), (2, "say one two now"), (3, "one two"), (4, "a b c d e f g h i q r s t u"), (3, "one two"), (5, None), (None, long)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, long), (1, long), (2, "one two"), (3, "now"), (4, ""), (None, "one two")], "item_id int, text string")
    rows = [sorted(map(tuple, decontaminate.contained(docs, bench, broadcast_shingles=n).collect()), key=str) for n in (2_000_000, 0)]
    assert rows[0] == rows[1] and (2, 2, 1, 1) in rows[0] and all(r[0] != 4 for r in rows[0])


# -- lines


def repeated_lines(rows, least):
    """Lines of later copies of repeated runs of at least so many words, by trying every run."""
    flat, first, gone = {}, {}, collections.defaultdict(set)
    for d, t in sorted(rows.items()):
        flat[d] = [(i, tuple(x.encode().split())) for i, x in enumerate(t.split("\n")) if x.encode().split()]
    for d, lines in flat.items():
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x for _, x in lines[a : b + 1])
                if sum(map(len, run)) >= least:
                    if run in first:
                        gone[d] |= set(range(a, b + 1))
                    else:
                        first[run] = d
    return {d: sorted(x) for d, x in gone.items()}


def test_lines(spark, docs, nothing):
    r = random.Random(4)
    lines = [sentence(r, n) for n in (3, 8, 30, 12, 5, 1, 26)]
    rows = {i: "\n".join(r.choice(lines + ["", " "]) if r.random() < 0.8 else sentence(r, 6) for _ in range(r.randrange(0, 14))) for i in range(40)}
    df = spark.createDataFrame([*rows.items(), (90, None)], "doc_id bigint, text string").repartition(5)
    want = repeated_lines(rows, line_dedup.MIN_WORDS)
    assert {x["doc_id"]: x["lines"] for x in line_dedup.deletions(df).collect()} == want and want
    for x in line_dedup.deduplicated(df).collect():
        keep = rows.get(x["doc_id"])
        own = [i for i, s in enumerate((keep or "").split("\n")) if s.split()]
        gone = {own[o] for o in want.get(x["doc_id"], [])}
        assert x["text"] == (keep if keep is None else "\n".join(s for i, s in enumerate(keep.split("\n")) if i not in gone))
    assert line_dedup.deletions(nothing).count() == 0 and line_dedup.deduplicated(docs).columns == docs.columns


# -- toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def test_automaton_finds_what_distances_find():
    r = random.Random(6)
    terms = ["trash", "idiot", "cat", "worthless", "disgusting", "moron", "clown"]
    trie = toxicity.Trie(terms)
    for _ in range(4000):
        w = list(r.choice(terms))
        for _ in range(r.randrange(0, 4)):
            i = r.randrange(len(w) + 1)
            w[i : i + r.randrange(0, 2)] = r.choice(["", "x", "o", "ss"])
        w = "".join(w)
        near = [(distance(w, t), i) for i, t in enumerate(terms) if distance(w, t) <= toxicity.allowed(t)]
        assert trie.nearest(w) == ((min(near)[1], min(near)[0]) if near else None)
    assert toxicity.Trie(["lowe*"]).nearest("loweian") == (0, 0) and toxicity.Trie(["lowe*"]).nearest("lowly") is None


def test_toxicity_learns(spark, nothing):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        w = sentence(r, 40).split()
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["grumble", "snarl", "vexing"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "grumbel you vexxing snarl")]
    docs, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {x["doc_id"]: x for x in toxicity.judged(docs, lab).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels if got[i]["held_out"])
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert got[902]["score"] > got[901]["score"] and 0 <= got[900]["score"] <= 1
    assert toxicity.judged(nothing, lab).count() == 0
    assert {x["predicted"] for x in toxicity.judged(docs, lab.filter("false")).collect()} == {0}
    assert toxicity.without_toxic(docs.withColumn("score", F.lit("own")), lab).columns == ["doc_id", "text", "score"]


def test_automata_together_find_what_distances_find():
    r = random.Random(16)
    letters = "abcdeé"
    for _ in range(4):
        terms = sorted({"".join(r.choice(letters) for _ in range(r.randrange(2, 12))) for _ in range(40)})
        words = ["".join(r.choice(letters + "*") for _ in range(r.randrange(0, 14))) for _ in range(150)] + ["a" * 70]
        for t in terms * 3:
            w = list(t)
            for _ in range(r.randrange(1, 4)):
                i = r.randrange(len(w) + 1)
                w[i : i + r.randrange(0, 2)] = r.choice(["", "x", "a", "bc"])
            words.append("".join(w))
        near = [[(distance(w, t), i) for i, t in enumerate(terms) if distance(w, t) <= toxicity.allowed(t)] for w in words]
        assert toxicity.Trie(terms).nearest_of_each(words) == [(min(x)[1], min(x)[0]) if x else None for x in near]
    assert toxicity.Trie(["lowe*"]).nearest_of_each(["loweian", "lowly", "lowe" * 20]) == [(0, 0), None, (0, 0)]


def test_toxicity_learns_the_words_of_a_small_language(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(3000):
        small = i % 40 == 0
        bad = (i // 40) % 12 == 0 if small else i % 8 == 1
        w = (["otro", "texto", "breve"] * 8 if small else sentence(r, 20).split())
        if bad:
            w.insert(r.randrange(len(w)), "malvado" if small else r.choice(["grumble", "snarl"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.learned(docs, lab)
    n_bad = sum(y for i, y in labels if zlib.crc32(str(i).encode()) % 5)
    assert 0 < sum("malvado" in t for i, t in rows if zlib.crc32(str(i).encode()) % 5) < 0.03 * n_bad
    assert "malvado" in model.terms or "malv*" in model.terms


def test_covered_words_keep_their_errors():
    rows = [{"word": w, "bad": b, "z": z} for w, b, z in (("reeuxa*", 27, 6.0), ("reeuxan", 12, 4.0), ("reeuxal", 11, 3.5))]
    terms = [r["word"] for r in toxicity.chosen(rows)]
    trie = toxicity.Trie(terms)
    assert set(terms) == {"reeuxa*", "reeuxan", "reeuxal"} and trie.nearest("reuxan") == (terms.index("reeuxan"), 1)
    assert trie.nearest_of_each(["reuxan", "reeuxabc"]) == [trie.nearest("reuxan"), (0, 0)]


def test_packed_columns_compress():
    """Small numbers in wide columns take little more than their own bytes, and come back as they were."""
    import pyarrow as pa

    from runlattice.llm import blobs

    r = np.random.default_rng(3)
    columns = [r.integers(0, 1 << 18, 5000), r.integers(0, 1 << 12, 5000).astype(np.int32), r.integers(0, 1 << 63, 5000).astype(np.uint64)]
    packed = blobs.pack(columns)
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(columns, blobs.unpack(packed, ["i8", "i4", "u8"])))
    assert [len(c) for c in blobs.unpack(blobs.pack([c[:0] for c in columns]), ["i8", "i4", "u8"])] == [0, 0, 0]
    assert len(pa.compress(packed, "lz4", asbytes=True)) < 5000 * (3 + 2 + 8.2)
