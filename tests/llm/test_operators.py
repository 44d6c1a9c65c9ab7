"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismatic.llm import bpe, chat, components, exact_dedup, hmm_lm, near_dedup, packing, secrets, sentence_dedup, shared, toxicity, vafile, wordblocks

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, key string, score string, block int, `__salt` int"


def rng_text(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(r.integers(0, len(WORDS), n), r.integers(0, 9, n)))


LONG = rng_text(5, 30_000)
TEXTS = [None, "", "  \n", "a", "A b", "a B", LONG, LONG.upper(), "naïve café 漢字 \U0001f600 x", "it's  ok\t\tyes\x0b<|endoftext|>", rng_text(1, 60), rng_text(1, 60), rng_text(1, 60) + " more", rng_text(2, 200), rng_text(2, 200)[:-6] + "q", 'password = "hunter2hunter" x', "api_key:abc token=abcdefgh AKIA" + "Z" * 16 + " " + "0a" * 14, "secret=token: abcdefgh"]


def rows(texts=TEXTS):
    return [(k, t, "en", f"src{k % 3}", 0, "h", "k", "s", 1, 2) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    # one row twice, and one without an id
    return spark.createDataFrame([*rows(), rows()[10], (None, "lost", "en", None, 0, "h", "k", "s", 1, 2)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]


def by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def test_secrets(spark, docs, none):
    got = by_id(secrets.judged(docs)[1])
    assert sum(map(len, got.values())) == docs.count()
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for i, t in pairs(docs):
        a = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        k = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        h = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        s = ",".join(f"{secrets.KINDS[x]}:{b}:{e}" for b, x, e in sorted(a + k + h))
        for r in got[i]:
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == (len(a), len(k), len(h))
            assert r["base_sha256"] == hashlib.sha256(s.encode()).hexdigest()
            assert set(s.split(",")) - {""} <= set(r["spans"].split(","))
    assert secrets.judged(none)[1].count() == 0


def test_secret_ownership(spark):
    own, wide = "Abc123" * 4, "Xyz789" * 4
    texts = [(1, f"say {own} 漢", "a"), (2, f"{own} again", "a"), (3, f"{wide}", "a"), (4, f"x {wide}", "b"), (5, f"x {wide}", None)]
    d = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = {i: r[0]["spans"] for i, r in by_id(secrets.judged(d)[1]).items()}
    assert got == {1: "owner:4:28", 2: "owner:0:24", 3: "", 4: "", 5: ""}
    # one owner, but spread over its repositories
    d = spark.createDataFrame([(k, f"x {own} {k}", lang, "a") for k, lang in enumerate(("en", "de", "fr"))] + [(9, f"y {wide}", "en", "a"), (10, f"y {wide}", "de", "a")], "doc_id long, text string, lang string, source string")
    assert {i: r[0]["spans"] for i, r in by_id(secrets.judged(d)[1]).items()} == {0: "", 1: "", 2: "", 9: "owner:2:26", 10: "owner:2:26"}


def test_secret_masking(spark):
    """What op1 reports is masked, whatever overlaps it: a key name that is a candidate itself, a value whose first part is one."""
    import corpus_pipeline

    run = "Abc123" * 4
    texts = ["漢 AWS_S3_BUCKET_SECRET_TOKEN=hunter2pass end", f"\ufeffsay token={run}.rest-of=it\U0001f600 and {run} \ufefflast", "password: secretvalue1 token=" + "0a" * 14, "plain", None, ""]
    d = spark.createDataFrame([(i, t, "en", f"s{i}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.secret_masking(spark, d, "").collect()}
    assert got == {0: "漢 [SECRET] end", 1: "\ufeffsay [SECRET]\U0001f600 and [SECRET] \ufefflast", 2: "[SECRET] [SECRET]", 3: "plain", 4: None, 5: ""}
    for i, rows in by_id(secrets.judged(d)[1]).items():
        dead = {k for s in filter(None, rows[0]["spans"].split(",")) for k in range(*map(int, s.split(":")[1:]))}
        kept = "".join(c for k, c in enumerate(texts[i] or "") if k not in dead)
        assert (got[i] or "").replace("[SECRET]", "") == kept


def test_prefix_sums(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 2, 7, 64, 1000):
        x = list(range(n))
        df = spark.createDataFrame([(x,)], "x array<int>").select(secrets.running(F.col("x")).alias("y"))
        assert df.first()["y"] == np.cumsum(x).tolist()


def test_exact_dedup(docs, none):
    """By bytes alone: with good keys, with keys that collide, and with keys spread over tasks, whose texts collide there too."""
    groups = collections.defaultdict(list)
    for i, t in pairs(docs):
        groups[re.sub("[\x20\x09-\x0d]", "", t)].append((i, len(t)))
    many = docs
    for _ in range(5):
        many = many.unionByName(many)
    one, few = lambda c: F.lit(1).cast("long"), lambda c: F.pmod(F.xxhash64(c), F.lit(3))
    for d, times, options in ((docs, 1, {"capacity": 2, "depth_limit": 6}), (docs, 1, {"hashed": one}), (docs, 1, {"hashed": few, "depth_limit": 1}), (many, 32, {"hashed": one, "share": 3}), (many, 32, {"hashed": few, "share": 3})):
        got = by_id(exact_dedup.decided(d, **options))
        assert sum(map(len, got.values())) == times * docs.count()
        for plain, members in groups.items():
            keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
            for i, _ in members:
                for r in got[i]:
                    assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, times * len(members), i == keep, hashlib.sha256(plain.encode()).hexdigest())
    assert exact_dedup.decided(none).count() == 0


def test_directory_doubles_and_splits():
    depth, slots = exact_dedup.directory({0: 10, 1: 1, 7: 1}, 2, 3)
    assert depth == 3 and len(slots) == 8 and len(set(slots)) == 4
    assert exact_dedup.directory({}, 2, 3) == (0, [0])


def test_hmm(docs, none):
    states, classes, rounds = 3, 16, 2
    got = by_id(hmm_lm.scored(docs, classes=classes, states=states, rounds=rounds))
    all_tokens = [(i, words(t) + ["\0end"]) for i, t in pairs(docs)]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in all_tokens for w in t if not held(i))
    n, v = sum(c.values()), len(c)
    cls = {w: classes if w == "\0end" else int(hmm_lm.hashes(pa.array([w]))[0] % classes) for _, t in all_tokens for w in t}
    in_class, kinds = np.zeros(classes + 1), np.zeros(classes + 1)
    for w, k in c.items():
        in_class[cls[w]] += k
        kinds[cls[w]] += 1
    frequency = (in_class + 1) / (in_class + 1).sum()
    m = hmm_lm.Model.first(states, frequency, 7)
    for _ in range(rounds):
        m = m.next(brute_counts(m, [[cls[w] for w in t] for i, t in all_tokens if not held(i)]), frequency)
    for i, t in all_tokens:
        a, score = None, 0.0
        for w in t:
            a = (m.start if a is None else a @ m.move) * m.emit[cls[w]]
            # within its class a word has the add-one estimate; the end is alone in its class
            score += np.log10(a.sum()) + (np.log10((c[w] + 1) / (in_class[cls[w]] + kinds[cls[w]] + 1)) if cls[w] < classes else 0.0)
            a = a / a.sum()
        for r in got[i]:
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(c[w] > 0 for w in t), n, held(i))
            assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
            assert r["score"] == pytest.approx(score, rel=1e-9)
    assert hmm_lm.scored(none, classes=16, states=2, rounds=1).count() == 0


def test_hmm_recursions():
    m = hmm_lm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.5, 0.1], [0.3, 0.2], [0.2, 0.7]]))
    seqs = [[0, 2, 1, 1], [2], [1, 0]]

    def brute(s):
        a = m.start * m.emit[s[0]]
        for x in s[1:]:
            a = (a @ m.move) * m.emit[x]
        return np.log10(a.sum())

    lens = np.array([len(s) for s in seqs])
    assert m.log10(np.concatenate(seqs), lens) == pytest.approx([brute(s) for s in seqs])


def brute_counts(m, docs):
    """Expected counts by plain forward and backward recursions over whole documents."""
    total = [np.zeros_like(m.start), np.zeros_like(m.move), np.zeros_like(m.emit)]
    for s in docs:
        a, b = [m.start * m.emit[s[0]]], [np.ones_like(m.start)]
        for x in s[1:]:
            a.append((a[-1] / a[-1].sum()) @ m.move * m.emit[x])
        for x in s[:0:-1]:
            b.append(m.move @ (m.emit[x] * b[-1] / b[-1].sum()))
        b = b[::-1]
        for t, x in enumerate(s):
            g = a[t] * b[t]
            total[2][x] += g / g.sum()
            total[0] += g / g.sum() if t == 0 else 0
            if t:
                xi = a[t - 1][:, None] * m.move * (m.emit[x] * b[t])
                total[1] += xi / xi.sum()
    return total


def test_hmm_training_takes_whole_texts():
    """Stretches of any length give the counts of the plain recursions, transitions between stretches included."""
    r = np.random.default_rng(6)
    m = hmm_lm.Model(*(x / x.sum(axis, keepdims=True) for x, axis in ((r.uniform(0.1, 1, 3), 0), (r.uniform(0.1, 1, (3, 3)), 1), (r.uniform(0.1, 1, (5, 3)), 0))))
    lens = np.array([1, 4, 200, 8, 3, 65, 64, 130, 4])
    docs = [r.integers(0, 5, n) for n in lens]
    want = brute_counts(m, docs)
    for segment, rows in ((64, 2048), (4, 3), (1, 7), (1000, 2)):
        total = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))]
        m.gather(np.concatenate(docs), lens, total, segment, rows)
        for a, b in zip(total, want):
            np.testing.assert_allclose(a, b, rtol=1e-9)
    assert total[1].sum() == pytest.approx(lens.sum() - len(lens))


def test_sentences(spark, none):
    shared_part = "One two three four five six seven. Eight nine ten eleven twelve thirteen. Red green blue white black pink grey."
    texts = [(1, f"First own words here. {shared_part} Its own end."), (2, f"Other start of it.\n{shared_part} Second end."), (3, "Nothing alike at all. Not here."), (4, None), (5, ""), (6, f"{shared_part} {shared_part}")]
    d = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, hash string")
    got = {i: r[0] for i, r in by_id(sentence_dedup.deduplicated(d)).items()}
    assert got[1]["clean_text"] == texts[0][1] and got[3]["clean_text"] == texts[2][1] and got[4]["clean_text"] == "" and got[5]["n_sentences"] == 0
    assert got[2]["clean_text"] == "Other start of it.\nSecond end." and got[2]["n_removed"] == 3 and got[2]["removed_spans"] == "1-3"
    assert got[6]["clean_text"] == ""
    assert sentence_dedup.deduplicated(none).count() == 0
    assert "".join(sentence_dedup.sentences_of(LONG + "\n\n a. b! \n")) == LONG + "\n\n a. b! \n"


def test_sentence_span_edges(spark):
    def said(tag, n):
        return " ".join(f"{tag}{j}" for j in range(n))

    # a passage that ends with short sentences; one with a single whole sentence; short sentences of under 20 words together
    closing, alone, short = f"{said('C', 40)}. {said('D', 8)}. {said('E', 5)}.", f"{said('F', 12)}. {said('G', 30)}. {said('H', 12)}", "One two three four five six. Red green blue white black. Up down left right so."
    texts = [(1, f"{closing} Own words. {alone} glued one. {short} Last one."), (2, f"Before it all. {closing} Quite other words follow it here and go on for a while until the end."), (3, f"Glued to {alone} the host."), (4, f"Start.\n{short} Finish.")]
    d = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, hash string")
    got = {i: r[0] for i, r in by_id(sentence_dedup.deduplicated(d)).items()}
    assert got[1]["clean_text"] == texts[0][1]
    assert got[2]["clean_text"] == "Before it all. Quite other words follow it here and go on for a while until the end."
    assert got[3]["clean_text"] == f"Glued to {said('F', 12)}. {said('H', 12)} the host."
    assert got[4]["clean_text"] == "Start.\nFinish."


def test_sentence_spans_of_shared_ids(spark):
    part = "One two three four five six seven eight. Red green blue white black pink grey and brown."
    other = "Entirely different words stand here in the first place. And quite different ones in the second place too."
    rows = [(1, f"{part} Tail."), (2, f"{part} Mine."), (2, f"{other} Yours."), (2, f"{other} Yours."), (None, "Up down left right so on and on until the very end of it all today. A."), (None, "Up down left right so on and on until the very end of it all today. B.")]
    got = sentence_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["clean_text"] for r in got if r["doc_id"]) == sorted([f"{part} Tail.", "Mine.", f"{other} Yours.", f"{other} Yours."])
    assert sorted(len(r["clean_text"]) for r in got if r["doc_id"] is None) == [2, len(rows[4][1])]


def test_sentence_spans_cover_runs(spark):
    """Every sentence of every repeated run of 15 or more words goes, and no other: against all runs of any length."""
    r = np.random.default_rng(4)
    pool = [" ".join(f"{WORDS[k % 18]}{k}{j}" for j in range(int(r.integers(1, 22)))) + "." for k in range(40)]
    texts = [" ".join(pool[k] for a in r.integers(0, 34, 3) for k in range(a, a + int(r.integers(1, 7)))) for _ in range(30)]
    got = {i: x[0] for i, x in by_id(sentence_dedup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).items()}
    first, every = {}, []
    for i, t in enumerate(texts):
        own = [s.strip() for s in sentence_dedup.sentences_of(t)]
        every += [(i, a, b, tuple(own[a:b])) for a in range(len(own)) for b in range(a + 1, len(own) + 1) if sum(len(s.split()) for s in own[a:b]) >= 15]
    for i, a, b, key in every:
        first.setdefault(key, (i, a))
    dead = {(i, k) for i, a, b, key in every if first[key] != (i, a) for k in range(a, b)}
    for i, t in enumerate(texts):
        own = sentence_dedup.sentences_of(t)
        assert got[i]["clean_text"] == "".join(s for k, s in enumerate(own) if (i, k) not in dead) and got[i]["n_removed"] == sum(x == i for x, _ in dead)
    assert dead


def test_bpe(docs, none):
    path = P.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoding(path, P.PATTERN)
    got = by_id(bpe.round_trip(docs, path, P.PATTERN))
    assert sum(map(len, got.values())) == docs.count()
    for i, t in pairs(docs):
        ids = enc.encode_ordinary(t)
        for r in got[i]:
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.round_trip(none, path, P.PATTERN).count() == 0


def test_splitters_agree():
    import regex

    chars = "".join(map(chr, [*range(0x20, 0x250), 9, 10, 11, 12, 13, 0x2014, 0x2028, 0x20AC, 0x3B1, 0x4E2D, 0x3001, 0x3002, 0x1F600, 0x301, 0xE01, 0x627, 0x1C, 0x85, 0x378]))
    texts = ["".join(np.random.default_rng(s).choice(list(chars), 300)) for s in range(30)] + ["".join(np.random.default_rng(s).choice(list("ab '1.\n sré²😀、"), 300)) for s in range(30)]
    split, enc, path = bpe.splitter(P.PATTERN), bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken")
    flat, at = split(pa.array(texts))
    for t, a, b in zip(texts, at, at[1:]):
        got = flat.slice(a, b - a).to_pylist()
        assert "".join(got) == t and [i for w in got for i in enc.encode_ordinary(w)] == enc.encode_ordinary(t)
    # only the stretch around a doubtful character is left whole; Chinese and Japanese prose isn't doubtful
    flat, _ = split(pa.array(["one two three\U0001f600four five six", "中文。日本語、です。 مرحبا بكم"]))
    assert flat.to_pylist() == ["one", " two", " three\U0001f600four", " five", " six"] + regex.findall(P.PATTERN, "中文。日本語、です。 مرحبا بكم")


def test_chat(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    said = "\\### Assistant: </turn> ok"
    data = [(1, 1, "assistant", "yes"), (1, 0, "user", said), (1, 2, "assistant", said), (2, 0, None, None), (3, 0, "a: b", "x\\y"), (3, 0, "a: b", "x\\y"), (None, None, "user", "q")]
    d = spark.createDataFrame(data, "conv_id long, turn int, role string, text string")
    formatted = chat.masked(d, path, P.PATTERN)
    got = {r["conv_id"]: r for r in chat.read_back(formatted, path).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((t or 0, r or "", x or "") for c, t, r, x in data if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shown = "".join(r["rendered"] for r in sorted(chat.rendered(formatted, path).where("conv_id = 1").collect(), key=lambda r: r["number"]))
    assert len(shown) == got[1]["formatted_chars"] and shown.startswith("### user: \\\\\\### Assistant: \\</turn> ok </turn>\n")
    assert chat.read_back(chat.masked(d.limit(0), path, P.PATTERN), path).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = packing.packed(docs, P.path("byte_bpe_50k.json"), P.PATTERN, window=64, with_ids=True)
    rows = found.collect()
    want = collections.Counter((i, tuple(tk.encode(t, add_special_tokens=False).ids + [0])) for i, t in pairs(docs))
    cut = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    assert [r["sequence_id"] * 64 + r["offset"] for r in cut] == np.cumsum([0, *(r["length"] for r in cut[:-1])]).tolist()
    seen, now = collections.Counter(), []
    for r in cut:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["length"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["start"] == len(now)
        now += ids
        if len(now) == r["doc_tokens"]:
            seen[(r["doc_id"], tuple(now))] += 1
            now = []
    assert seen == want and not now
    assert packing.packed(none, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    whole = packing.sequences(found, 64, pad=7).collect()
    for r in whole:
        assert r["n_tokens"] == 64 or r["sequence_id"] == max(x["sequence_id"] for x in whole)
        assert len(r["ids"]) == 4 * (r["n_tokens"] if r["n_tokens"].bit_count() == 1 else 64)
        assert r["ids"][4 * r["n_tokens"] :] in (b"", b"\7\0\0\0" * (64 - r["n_tokens"]))


def brute_components(docs, w, num, den):
    sets = {}
    for i, t in docs:
        x = words(t)
        sets[i] = {tuple(x[k : k + w]) for k in range(len(x) - w + 1)} if len(x) >= w else {tuple(x)} if x else set()
    root = {i: i for i in sets if i is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in root:
        for b in root:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return sets, {i: top(i) for i in root}


def test_near_dedup(spark, docs, none):
    base = rng_text(9, 300).split()
    chain = []
    for k in range(40):  # neighbours alike, ends not
        chain.append(" ".join(base[k * 5 : k * 5 + 100]))
    many = spark.createDataFrame([(k + 100, t) for k, t in enumerate(chain)], "doc_id long, text string")
    for d, w, num in ((docs, 3, 85), (docs, 5, 80), (many, 3, 85), (many, 5, 80)):
        sets, want = brute_components(pairs(d), w, num, 100)
        for i, found in by_id(near_dedup.near_duplicates(d, w, num, 100)).items():
            for r in found:
                assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), want.get(i), i == want.get(i))
    assert near_dedup.near_duplicates(none).count() == 0


def test_block_pairs_cover_all(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    base = rng_text(3, 120).split()
    d = spark.createDataFrame([(k, " ".join(base[: 110 - (k % 3)] + [f"end{k}", f"tail{k}"] * (1 + k % 2))) for k in range(30)], "doc_id long, text string")
    _, want = brute_components(pairs(d), 3, 95, 100)
    assert {i: r[0]["component_id"] for i, r in by_id(near_dedup.near_duplicates(d, 3, 95, 100)).items()} == want


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31), (31, 30), (40, 40)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(21)}, 30: 30, 31: 30}
    assert components.components(links.limit(0)).count() == 0


def test_toxicity(spark, docs, none):
    labels = lambda r: spark.createDataFrame(r, "doc_id long, quality int, toxic int")
    bad = ["vilezan", "vilezor", "foulish"]
    data = [(k, rng_text(k, 40) + (f" {bad[k % 3]}! {rng_text(k + 1, 5)} {bad[(k + 1) % 3]}" if k % 4 == 0 else "")) for k in range(400)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = by_id(toxicity.scored(d, labels([(k, 0, int(k % 4 == 0)) for k in range(400)] + [(None, 0, 1), (9999, 0, 1), (1, 0, None)])))
    held = [(k, got[k][0]) for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(r["held_out"] for _, r in held) and sum(r["predicted"] == (k % 4 == 0) for k, r in held) / len(held) > 0.95
    assert toxicity.scored(docs, labels([])).count() == docs.count()
    assert toxicity.scored(none, labels([])).count() == 0
    kept = toxicity.accepted(docs, labels([]))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_top_k(spark):
    r = np.random.default_rng(4)
    rows = [(k, [float(x) for x in r.normal(0, 1, 8)]) for k in range(300)]
    rows += [(20, rows[20][1]), (301, None), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (320, [float("inf")] * 8), (340, [1.0] * 3), (341, [2.0] * 3), (None, [0.5] * 8), (400, [1e12] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for x in vafile.top_k(d, 20, 5).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    for n, (q, v) in enumerate(good):
        if q is None or q % 20 or q == 20:
            continue
        want = sorted(((-sum(a * b for a, b in zip(v, u)), 1 << 62 if i is None else i) for m, (i, u) in enumerate(good) if m != n and len(u) == len(v)))[:5]
        assert [(s, i) for _, i, s in got[q]] == [(-s, None if i == 1 << 62 else i) for s, i in want], q
    assert len(got[20]) == 10 and got[20][0][1] == 20
    assert vafile.top_k(d.limit(0)).count() == 0


def test_top_k_reads_few_exact_vectors(spark):
    """The scan of the cells leaves a small part of all pairs; one very common vector doesn't multiply them."""
    r = np.random.default_rng(8)
    rows = [(k, [float(x) for x in r.normal(0, 1, 32)]) for k in range(4000)]
    rows += [(k, [0.25] * 32) for k in range(4000, 6000)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = vafile.candidates(vafile.whole(d), 20, 10).count()
    assert 300 * 10 <= near < 300 * 40  # of 300 * 6000


def test_cells_bound_scores():
    r = np.random.default_rng(9)
    exact = np.floor(64 * np.concatenate([r.normal(0, 1, (500, 6)), r.normal(0, 1, (3, 6)) * 1e9]))
    block = vafile.Block.of(np.arange(503), np.arange(503), exact, 5)
    again = vafile.Block.unpacked(block.packed())
    assert again.cells.dtype == np.uint8 and (again.cells == block.cells).all() and (again.rows == block.rows).all()
    q = np.floor(r.normal(0, 64, (20, 6)))
    low, high = again.bounds(q, 0)
    true = q @ exact[again.rows].T
    assert (low <= true).all() and (true <= high).all()


def test_pack_round_trip():
    parts = [np.arange(1000, dtype=np.uint32), b"abc", np.zeros(0, dtype=np.int64), b""]
    assert shared.unpack(shared.pack(*parts)) == [parts[0].tobytes(), b"abc", b"", b""]


def test_skew_join(spark):
    left = spark.range(5000).selectExpr("case when id < 4000 then 7 else id end as k", "id")
    right = spark.createDataFrame([(7, "a"), (4500, "b"), (9999, "c")], "k long, v string")
    got = shared.skew_join(left, right, ["k"]).groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in got} == {"a": 4000, "b": 1}


PIPELINE = "doc_id long, text string, lang string, source string, n_chars long, `__row` long, `__live` string, `__id` int, `a.b` string, spans string, doc string, id string"


def written(spark, folder, texts, labels, schema=PIPELINE, again=(10,)):
    frame = [(k, t, "en", f"src{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    frame = [(*r, 1, "x", 2, "y", "s", "d", "i") for r in [*frame, *(frame[k] for k in again)]]
    spark.createDataFrame(frame, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def brute_pipeline(texts, source, bad):
    """ids and texts after each stage, in plain Python: bad says which documents the classifier rejects."""
    docs = {k: t for k, t in enumerate(texts) if not bad(k)}
    yield dict(docs)
    groups = collections.defaultdict(list)
    for k, t in docs.items():
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append(k)
    stay = {min(g, key=lambda k: (-len(docs[k] or ""), k)) for g in groups.values()}
    docs = {k: t for k, t in docs.items() if k in stay}
    yield dict(docs)
    _, root = brute_components([(k, t or "") for k, t in docs.items()], 5, 80, 100)
    docs = {k: t for k, t in docs.items() if root[k] == k}
    yield dict(docs)
    assign = re.compile(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    spans, owners = collections.defaultdict(list), collections.defaultdict(set)
    for k, t in docs.items():
        t = t or ""
        own = [(m.start(), m.end(), m[1]) for m in assign.finditer(t) if len(m[1]) >= 6]
        own += [(m.start(), m.end(), m[0]) for p, n in (("AKIA[A-Z0-9]+", 20), ("[0-9a-f]+", 24)) for m in re.finditer(p, t) if len(m[0]) >= n]
        bare = [(m.start(), m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_-]+", t) if len(m[0]) >= 20 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        spans[k] = [own, bare]
        for *_, value in own + bare:
            owners[value].add(source(k))
    for k, t in docs.items():
        dead = sorted([s[:2] for s in spans[k][0]] + [s[:2] for s in spans[k][1] if len(owners[s[2]]) == 1])
        merged = []
        for a, b in dead:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in reversed(merged):
            t = t[:a] + "[SECRET]" + t[b:]
        docs[k] = t
    yield docs


def test_pipeline(spark, tmp_path):
    """Every stage and run() against plain Python; clashing and odd column names go through."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    texts = [*TEXTS, "key Abc123Abc123Abc123Abc123 one", "key Abc123Abc123Abc123Abc123 two words", "only Xyz789Xyz789Xyz789Xyz789 here"]
    toxic = [f"{rng_text(k, 30)} vilezan {rng_text(k + 500, 5)} foulish" for k in range(900, 960)]
    clean = [rng_text(k, 40) for k in range(1000, 1120)]
    n = len(texts)
    texts += toxic + clean
    bad = lambda k: n <= k < n + 60
    written(spark, tmp_path, texts, [(k, 0, int(bad(k))) for k in range(n, len(texts))])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [x for x, _ in corpus_pipeline.STAGES]
    want = list(brute_pipeline(texts, lambda k: k % 2, bad))
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        docs = shared.materialize(out, "test")
        rows = docs.collect()
        assert {r["doc_id"]: r["text"] for r in rows} == expected, name
        assert len(rows) == len(expected) + (name == "toxicity"), name  # one row came twice
        assert all(r["__row"] == 1 and r["a.b"] == "y" and r["spans"] == "s" and r["doc"] == "d" and r["n_chars"] == len(r["text"] or "") for r in rows)
    assert names == ["toxicity", "exact_dedup", "near_dedup", "secret_scans", "packing"]
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = collections.Counter()
    for r in pieces:
        got[r["doc_id"]] += r["length"]
        assert r["offset"] + r["length"] <= 1024
    assert got == {k: len(tk.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in want[-1].items()}
    assert len(shared.WRITTEN) < 60


def test_pipeline_without_labels_or_documents(spark, tmp_path):
    """Without usable labels nothing is rejected, at the default threshold; an empty table goes through all stages."""
    import corpus_pipeline

    for k, labels in enumerate(([], [(1, 0, None), (None, 0, 1), (999, 0, 1)], [(1, 0, 1), (2, 0, 1), (3, 0, 1)])):
        written(spark, f"{tmp_path}/{k}", TEXTS, labels)
        docs = spark.read.parquet(f"{tmp_path}/{k}/documents.parquet")
        assert corpus_pipeline.toxicity_filter(spark, docs, f"{tmp_path}/{k}").count() == docs.count()
        found = toxicity.scored(docs, spark.read.parquet(f"{tmp_path}/{k}/labels.parquet")).collect()
        assert {r["predicted"] for r in found} == {0} and all(0.49 < r["score"] < 0.5 for r in found)
    written(spark, f"{tmp_path}/none", [], [], again=())
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_tasks_with_several_buckets(docs, monkeypatch):
    path = P.path("byte_bpe_50k.tiktoken")
    results = lambda: [sorted(map(str, f.collect())) for f in (bpe.round_trip(docs, path, P.PATTERN), hmm_lm.scored(docs).select("doc_id", "n_known", "train_tokens", F.round("base_score", 6), F.round("score", 4)))]
    usual = results()
    for module in (bpe, hmm_lm):
        monkeypatch.setattr(module, "buckets_for", lambda docs: 37)
    monkeypatch.setattr(wordblocks, "MOST_TASKS", 3)
    assert results() == usual
