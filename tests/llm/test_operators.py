"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import ann, bloomlm, bpe, fertility, linkrank, mixing, nearcopies, simhash, tokenfile, toxicity, transcript
from lectern.llm.common import shared_dir

ODD = [None, "", " ", "one", "a b c a b c a b c", "  two  spaces\n\nlines\t", "x<|endoftext|>y", "naïve Ünïcode 日本語 текст — “q”", "a" * 3000, "word " * 4000, "don't  we'll", "\x00 \x1c\x85 z", "one"]
SCHEMA = "doc_id long, text string, source string, lang string, score string, N_TOKENS string"


def docs(spark, texts, **more):
    rows = [(k if t != "one" else 3, t, None if k % 3 == 0 else f"s{k % 3}", "en", "kept?", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


def by_text(rows, *names):
    return {r["text"]: tuple(r[n] for n in names) for r in rows}


def test_bpe_is_the_library(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = by_text(bpe.digests(odd).collect(), "n_tokens", "ids_sha256", "decoded_sha256")
    assert len(bpe.digests(odd).columns) == 5 + 3
    for text in ODD:
        ids = own.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        assert found[text] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()), text
    back = bpe.decoded(bpe.encoded(odd.filter("text is not null").select("text")).withColumnRenamed("text", "before")).collect()
    assert all(r["before"] == r["text"] for r in back)
    assert bpe.digests(docs(spark, [])).count() == 0


def test_bpe_of_long_runs_is_the_library():
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    own, words = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.vocabulary()
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    some = ["".join(rng.choices(letters, k=n)) for n in (511, 512, 513, 4000)]
    some += ["".join(rng.choices(letters + letters.upper() + "0123456789+/=", k=20_000)), "a" * 5001, "ab" * 3000, "日本語の長い文" * 400, "-" * 1000 + "=" * 999, "x " + " " * 900 + "y"]
    for text in some:
        assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, text[:20]
    start = time.time()
    long = "".join(rng.choices(letters, k=1_000_000))
    assert np.frombuffer(words.encode([long])[0], "<u4").tolist() == own.encode(long, add_special_tokens=False).ids
    assert time.time() - start < 90


def test_token_files(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    shards = tokenfile.write(odd, shared_dir(spark, "t"), shards=3)
    rows = sorted(tokenfile.read(spark, shards).collect(), key=lambda r: r["start"])
    assert sum(s.n_docs for s in shards) == len(ODD) == len(rows)
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    want = Counter((r["doc_id"], tuple(own.encode(r["text"] or "", add_special_tokens=False).ids) + (1,)) for r in odd.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]
    digest = {r["start"]: r["ids_crc32"] for r in tokenfile.read(spark, shards, digest=True).collect()}
    assert all(digest[r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    picked = tokenfile.documents(spark.createDataFrame([(s.path,) for s in shards], "path string"), spark.createDataFrame([(5,), (99,)], "doc_id long")).collect()
    assert [(r["doc_id"], r["ids"]) for r in picked] == [(r["doc_id"], r["ids"]) for r in rows if r["doc_id"] == 5]
    assert tokenfile.write(docs(spark, []), shared_dir(spark, "t")) == [] and tokenfile.read(spark, []).count() == 0


def test_damaged_frame_is_noticed(tmp_path):
    writer = tokenfile.ShardWriter((tmp_path / "x").open("wb"), np.dtype("<u2"), frame=100)
    for k in range(50):
        writer.add(k if k % 5 else None, np.arange(k, dtype="<u2").tobytes())
    writer.close()
    writer.out.close()
    data = bytearray((tmp_path / "x").read_bytes())
    reader = tokenfile.ShardReader((tmp_path / "x").open("rb"), len(data))
    assert all(reader.document(k).tolist() == list(range(k)) for k in range(50)) and reader.doc_ids[:2] == [None, 1]
    data[int(reader.starts[3]) + 12] ^= 255
    (tmp_path / "x").write_bytes(data)
    broken = tokenfile.ShardReader((tmp_path / "x").open("rb"), len(data))
    with pytest.raises(Exception):  # noqa: B017  zstandard's own checksum or the table's
        broken.frame(3)
    assert broken.frame(2) == reader.frame(2)


def test_fertility_base_counts(spark, odd):
    rows = fertility.judged(odd).collect()
    for r in rows:
        text = r["text"] or ""
        words = text.encode().split()
        seen = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = text.split("\n")
        repeats = sum(1 for k, line in enumerate(lines) if line.strip(" \t\n\r\x0b\x0c") and line in lines[:k])
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), len(covered), repeats)
        assert r["word_chars"] == sum(len(w.decode()) for w in words)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not r["kept"] or not r["base_failed"]
    prose = " ".join(random.Random(1).choices("the quick brown fox jumps over a lazy dog while it sleeps near old rivers".split(), k=80))
    shouted = " ".join(w.upper() + "!!#" for w in random.Random(2).choices("qzx vbn wkrt plmg hjtr xcvb zzqw".split(), k=80))
    kept = by_text(fertility.judged(docs(spark, [prose, shouted])).collect(), "kept")
    assert kept == {prose: (True,), shouted: (False,)}
    assert fertility.judged(docs(spark, []).drop("lang")).count() == 0


PROSE = {
    "cyrillic": "Мой дедушка каждое утро выходил в сад и долго смотрел на старые яблони [1], которые посадил ещё его отец.",
    "greek": "Κάθε πρωί ο παππούς μου έβγαινε στον κήπο και κοιτούσε για ώρα τις παλιές μηλιές | που είχε φυτέψει ο πατέρας του.",
    "arabic": "كان جدي يخرج كل صباح إلى «الحديقة» وينظر طويلا إلى أشجار التفاح القديمة [التي] زرعها والده.",
    "hebrew": "סבא שלי היה יוצא כל בוקר לגינה ומביט זמן רב בעצי התפוח הישנים | שאביו נטע.",
    "devanagari": "मेरे दादाजी हर सुबह बगीचे में जाते थे और उन पुराने सेब के पेड़ों को देर तक देखते थे [१] जो उनके पिता ने लगाए थे।",
    "thai": "คุณปู่ของฉัน ออกไปที่สวนทุกเช้า และมองดูต้นแอปเปิลเก่า_ที่พ่อของเขาปลูกไว้ เป็นเวลานาน",
    "han": "我爷爷 每天早上 都会去花园，久久地 看着他父亲 种下的 老苹果树。",
    "kana": "そふは まいあさ にわに でて、ちちが うえた ふるい りんごの きを ながめていました。",
    "hangul": "할아버지는 매일 아침 정원에 나가 아버지가 심은 오래된 사과나무를 오랫동안 바라보셨다.",
    "other": "ბაბუაჩემი ყოველ დილით გადიოდა ბაღში და დიდხანს უყურებდა ძველ ვაშლის ხეებს, რომლებიც მამამისმა დარგო.",
    "latin": "Mój dziadek każdego ranka wychodził do ogrodu i długo patrzył na stare jabłonie, które zasadził jego ojciec.",
    "none": "123 4567 890 12 3456 78 90",
}


def test_fertility_bands_by_script(spark):
    assert {name: fertility.main_script(text) for name, text in PROSE.items()} == {name: name for name in PROSE}
    rng, rows = random.Random(4), []
    for name, text in PROSE.items():
        for k, n in enumerate((60, 8000)):
            body = " ".join(w + rng.choice([text[j] for j in range(len(text)) if text[j].isalnum()]) for w in rng.choices(text.split(), k=n))  # not in repeated windows
            rows.append((len(rows), body, name, None if k else "xx"))
    noise = " ".join("".join(rng.choices("#*$%&|<>{}~^", k=5)) for _ in range(80))
    rows += [(len(rows), noise, "noise", lang) for lang in ("en", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, name string, lang string")
    out = fertility.judged(table).collect()
    assert {r["name"] for r in out if not r["kept"]} == {"noise"} and sum(not r["kept"] for r in out) == 2
    for r in out:  # the verdict by the stated bands, plainly
        band = fertility.BANDS["en" if r["lang"] == "en" and r["script"] in ("latin", "none") else r["script"]]
        low, high = band.chars_per_token
        good = r["n_tokens"] < band.least_tokens or (low <= r["chars_per_token"] <= high and r["byte_share"] <= band.byte_share and r["entropy_ratio"] >= band.entropy_ratio)
        assert r["kept"] == (good and not r["base_failed"])


def brute_components(fps, radius):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label] if a != b else label
    return label


def test_simhash_against_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(25)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)]
    fps = list(dict.fromkeys(base + near + [0, 1, 3, 7]))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(fps, 2)
    for tree in (simhash.TREE, 2):  # the second deals nearly every shard again
        stars = {r["node"]: r["root"] for r in simhash.components(simhash.hamming_links(table, 2, tree)).collect()}
        got = [stars.get(x, x) for x in signed]
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_simhash_groups_odd_rows(spark, odd):
    import xxhash

    rows = simhash.grouped(odd).collect()
    assert len(rows) == len(ODD)
    zero = sorted(r["doc_id"] for r in rows if r["fingerprint"] == "0" * 16)
    assert zero == [0, 1, 2] and all(r["component_id"] == 0 for r in rows if r["doc_id"] in zero)
    assert {r["fingerprint"] for r in rows if r["doc_id"] == 3} == {f"{xxhash.xxh64_intdigest(b'one', 42):016x}"}
    assert simhash.grouped(docs(spark, [])).count() == 0


def test_fingerprints_are_majorities(spark):
    """Every bit against its plain count over all shingles, repeats included, for texts of one word up to very many."""
    import xxhash

    rng = random.Random(12)
    texts = ["One", "a B", "a b c", "a b c d", "x x x x x", " tab\tand\x0bline\n end ", "Ünï Cödé ÄB ok", "w " * 20_001]
    texts += [" ".join(rng.choices([f"W{k}" for k in range(30)], k=rng.randrange(3, 60))) for _ in range(40)]
    rows = {r["doc_id"]: r["fingerprint"] for r in simhash.grouped(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        low = "".join(c.lower() if c.isascii() else c for c in text)
        words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if w]
        grams = [" ".join(words[j : j + 3]) for j in range(len(words) - 2)] or [" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert rows[k] == f"{bits:016x}", text[:30]


def test_near_copies_keep_one_of_each_group(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    base = [rng.choices(words, k=120) for _ in range(12)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for _ in range(6):
            c = list(b)
            c[rng.randrange(120)] = "changed"
            texts.append(" ".join(c))
    texts += [texts[0], None, "", "  ", "short", "short text"]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(3, texts[3], "x"), (None, texts[1], "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    kept = sorted(r["doc_id"] for r in nearcopies.without_copies(table).collect())
    sets = {k: set(nearcopies.shingles((t or "").encode()).tolist()) for k, t in enumerate(texts)}
    label = {k: k for k in sets}
    for i in sets:
        for j in range(i):
            if (sets[i] | sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8) or not sets[i] | sets[j]:
                a, b = label[i], label[j]
                label = {k: min(a, b) if x in (a, b) else x for k, x in label.items()}
    assert kept == sorted(set(label.values()))
    parts = nearcopies.without_copies(table, tree=8, family=3000)  # nearly every group is dealt into parts
    assert parts.columns == table.columns and sorted(r["doc_id"] for r in parts.collect()) == kept
    assert nearcopies.without_copies(table.limit(0)).count() == 0
    from pyspark.sql import functions as F

    clash = table.withColumns({c: F.lit(c) for c in ("doc", "t", "key", "id", "of_text", "root", "set", "node", "n", "kept", "ROW_KEY_")})
    out = nearcopies.without_copies(clash)
    assert out.columns == clash.columns and sorted(r["doc_id"] for r in out.collect()) == kept


def test_families_between_the_bounds(spark):
    """A template's texts are alike in 0.7 to 0.79; only some pairs among them are copies, and none may be lost."""
    rng = random.Random(8)
    base = [f"t{k}" for k in range(200)]
    texts = []
    for k in range(60):
        c = list(base)
        for at in rng.sample(range(200), 4):
            c[at] = f"own{k}"
        texts.append(c)
        if k % 4 == 0:
            c = list(c)
            c[rng.randrange(200)] = "again"
            texts.append(c)
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(nearcopies.shingles(t.encode()).tolist()) for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    for options in ({}, {"tree": 20, "family": 4000}):
        got = sorted(r["doc_id"] for r in nearcopies.without_copies(table, **options).collect())
        assert got == sorted(set(label)) and 20 < len(got) < len(texts)


def test_mixing_meets_targets(spark, odd):
    rng = random.Random(7)
    rows = [(k, "w " * rng.randrange(0, 60), rng.choice(["b", "a", None, "c", "é"]) if k > 300 else "a", 9) for k in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    taken = mixing.taken(table).collect()
    size = Counter()
    for r in taken:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["copies"] <= 3
        size[r["source"]] += r["size"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, (5, 2, 1) * 9))
    target, free, left = {}, set(order), float(sum(size.values()))
    while free:  # share, stop at the caps, share the excess again
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > 3 * size[s]}
        for s in above or free:
            target[s] = 3.0 * size[s] if above else left * weight[s] / total
        left -= sum(target[s] for s in above)
        free = free - above if above else set()
    for s in order:
        got = sum(r["copies"] * r["size"] for r in taken if r["source"] == s)
        assert [r["target"] for r in taken if r["source"] == s][0] == pytest.approx(target[s])
        assert abs(got - target[s]) <= 2  # what is left is less than the smallest documents
    for r in mixing.multipliers(table).collect():  # the rates themselves meet the targets
        own = [x["size"] for x in taken if x["source"] == r["source"]]
        if 0 < r["target"] < 3 * sum(own) * (1 - 1e-9):
            rates = [min(3.0, math.exp(min(2.0, r["multiplier"] * x / r["scale"]))) for x in own]
            assert sum(a * b for a, b in zip(rates, own)) == pytest.approx(r["target"], rel=1e-6)
    assert [tuple(r) for r in sorted(taken, key=str)] == [tuple(r) for r in sorted(mixing.taken(table.repartition(3)).collect(), key=str)]
    assert sorted(r["doc_id"] for r in mixing.mixed(table).collect()) == sorted(r["doc_id"] for r in taken for _ in range(r["copies"]))
    assert mixing.taken(odd).count() == len(ODD) and mixing.taken(docs(spark, [])).count() == 0
    alike = spark.createDataFrame([(None, "a b c", "p")] * 30 + [(7, "d e", "q")] * 30, "doc_id long, text string, source string")
    rows = mixing.taken(alike).collect()  # rows that repeat round alike, and none exceeds its bound
    assert len(rows) == 60 and len({(r["source"], r["copies"]) for r in rows}) == 2 and max(r["copies"] for r in rows) <= 3


def test_targets_of_many_sources(spark):
    rng = random.Random(3)
    size = {f"host{k}": rng.choice([0, 1, 5, 100, 3000]) for k in range(200)} | {None: 50, "é": 7}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, (5.0, 2.0, 1.0) * 99))
    found = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
    low, high = 0.0, 1e9
    for _ in range(200):  # the level by bisection
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(3 * size[s], weight[s] * middle) for s in order) < sum(size.values()) else (low, middle)
    assert all(found[s] == pytest.approx(min(3 * size[s], weight[s] * low)) for s in order)


def test_language_scores(spark, odd):
    rng = random.Random(9)
    words = [f"v{k}" for k in range(300)]
    texts = ODD + [" ".join(f"{a} next-{a}" for a in rng.choices(words, k=40)) for _ in range(60)]
    table = docs(spark, texts)
    train = "doc_id % 4 <> 2"
    from pyspark.sql import functions as F

    rows = bloomlm.language_scores(table, F.expr(train)).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    counts = Counter(w for r in table.collect() if r["doc_id"] % 4 != 2 for w in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        ws = tokens(r["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
    held = [r for r in rows if r["doc_id"] % 4 == 2 and r["n_tokens"] == 81]
    assert len(held) > 5 and all(r["score"] > r["base_score"] for r in held)  # pairs tell
    clash = bloomlm.language_scores(table.withColumns({c: F.lit("x") for c in ("of_row", "row_of_text", "tail_known", "head_", "segment", "TRAIN_TOKENS")}), F.expr(train))
    assert clash.columns[-1] == "train_tokens" and sorted(r["score"] for r in clash.collect()) == sorted(r["score"] for r in rows)
    assert bloomlm.language_scores(docs(spark, []), F.expr(train)).count() == 0
    nothing = bloomlm.language_scores(odd, F.lit(False)).collect()
    assert len(nothing) == len(ODD) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in nothing)


def test_scores_against_exact_counts(spark):
    """The score with the filter's counts lies by the score with exact ones, quantised to the same levels."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    words = [f"q{k}" for k in range(500)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(500)], k=rng.randrange(1, 80))) for _ in range(300)]
    rows = bloomlm.language_scores(docs(spark, texts), F.expr("doc_id % 3 <> 2")).collect()
    tokens = lambda t: t.encode().split() + [b"\n"]
    pairs_of = lambda w: list(zip([w[-1], *w[:-1]], w))
    train = [tokens(t) for k, t in enumerate(texts) if k % 3 != 2]
    count, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in pairs_of(t))
    level = lambda c: bloomlm.EXPECTED[int(bloomlm._levels(np.array([c]))[0])] if c else 0.0
    total = float(sum(count.values()) + len(count) + 1)
    off = []
    for r in rows:
        exact = 0.0
        for a, b in pairs_of(tokens(r["text"])):
            ca, cb, cab = level(count[a]), level(count[b]), level(pairs[a, b])
            trust = min(ca / (ca + bloomlm.MU), bloomlm.TRUST)
            exact += math.log10(trust * min(min(cab, cb) / max(ca, 1), 1) + (1 - trust) * (cb + 1) / total)
        off.append((r["score"] - exact) / r["n_tokens"])
    assert np.mean(np.abs(off)) < 0.05 and min(off) > -0.05  # a filter finds too much at times, never too little


def test_filter_gives_counts_back():
    hashes = bloomlm.mixed_bits(np.arange(1, 5001, dtype=np.uint64))
    counts = np.random.default_rng(0).integers(1, 500, 5000)
    data = bloomlm.LogFrequencyFilter.segment(hashes, counts, 5000 * 14 * 12)
    found = bloomlm.LogFrequencyFilter(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([5000 * 14 * 12])).counts(hashes)
    assert (np.abs(np.log(found / counts)) <= math.log(bloomlm.BASE) * 1.01).mean() > 0.97  # quantised, seldom too high


def test_filter_grows_with_the_counts(spark, monkeypatch):
    monkeypatch.setattr(bloomlm, "ASKED", 3000, raising=False)  # many blocks
    monkeypatch.setattr(bloomlm, "MOST_BYTES", 1 << 10, raising=False)
    monkeypatch.setattr(bloomlm.trained, "__defaults__", tuple(1 << 10 if x == 64 << 20 else x for x in bloomlm.trained.__defaults__))
    from pyspark.sql import functions as F

    texts = [" ".join(f"g{40 * k + j}" for j in range(40)) for k in range(600)]
    rows = bloomlm.language_scores(docs(spark, texts), F.expr("doc_id % 2 = 0")).collect()
    seen, unseen = (np.array([r["score"] for r in rows if r["doc_id"] % 2 == k]) for k in (0, 1))
    assert len(rows) == 600 and max(seen.max(), unseen.max()) < 0 and seen.mean() > unseen.mean() + 8  # a full filter gives one score


def test_pairs_seen_once_count(spark):
    from pyspark.sql import functions as F

    words = [f"w{k}" for k in range(300)]
    rows = bloomlm.language_scores(docs(spark, [" ".join(words), " ".join(reversed(words))]), F.expr("doc_id = 0")).collect()
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[0] > score[1] + 300  # the same words, but pairs seen once against unseen ones


def test_toxicity_learns_held_out(spark, odd):
    rng = random.Random(11)
    words = [f"n{k}" for k in range(400)]
    bad = ["vile", "rotten", "scummy"]
    texts, labels = [], []
    for k in range(260):
        t = rng.choices(words, k=rng.randrange(20, 90))
        if k % 4 == 0:
            for _ in range(2):
                t[rng.randrange(len(t))] = rng.choice(bad)
        texts.append(" ".join(t).encode())
        labels.append(int(k % 4 == 0))
    net = toxicity.train(texts[:180], labels[:180])
    score = toxicity.Scorer(net.dumps()).score(texts[180:])
    assert ((score >= toxicity.THRESHOLD) == np.array(labels[180:], bool)).mean() > 0.9
    rows = toxicity.scored(odd, net.dumps()).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["text"] in (None, "", " ")}) == 1
    whole = toxicity.Scorer(net.dumps()).score([b"n1 " * 200_000 + b"vile rotten", b"n1 " * 50])
    assert whole[0] > whole[1]  # the end of a very long text counts
    constant = toxicity.train(texts[:4], [0, 0, 0, 0])
    assert toxicity.Scorer(constant.dumps()).score([b"x", b""]).max() < 0.3


def test_toxicity_learns_from_odd_labels(spark, odd):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (5, None), (6, 0), (6, 0), (7, 7), (999, 1), (8, 0)], "doc_id long, toxic int")
    for held, allowed in ((labels, F.lit(True)), (labels.limit(0), F.lit(True)), (labels, F.lit(False)), (labels.filter("toxic = 0"), F.lit(True))):
        weights = toxicity.fitted(odd, held, allowed)
        rows = toxicity.scored(odd, weights).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        assert weights == toxicity.fitted(odd.repartition(3), held, allowed)  # reruns agree
    assert toxicity.scored(docs(spark, []), toxicity.fitted(docs(spark, []), labels, F.lit(True))).count() == 0
    text = " ".join(f"n{k}" for k in range(20_000)) + " vile"
    net = toxicity.train([text.encode(), b"n1 n2"] * 3, [1, 0] * 3)
    assert toxicity.Scorer(net.dumps()).score([text.encode()]).shape == (1,)


def test_toxicity_reads_long_words_whole():
    rng = random.Random(12)
    texts, labels = [], []
    for k in range(240):
        t = rng.choices([f"n{x}" for x in range(400)], k=90)
        if k % 3 == 0:
            t[40:40] = t[80:80] = ["vile", "rotten"]
        texts.append(("\u00a0", "_", "\u200b")[k % 7 % 3].join(t).encode())  # one word for the whole text
        labels.append(int(k % 3 == 0))
    net = toxicity.train(texts[:160], labels[:160])
    score = toxicity.Scorer(net.dumps()).score(texts[160:])
    assert ((score >= toxicity.THRESHOLD) == np.array(labels[160:], bool)).mean() > 0.9
    long = bytes(range(33, 127)) * 3
    assert {long[k : k + 3] for k in range(len(long) - 2)} == {w[k : k + 3] for w in toxicity.words_of(long) for k in range(len(w) - 2)}


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask = rng.normal(size=(5, 3, toxicity.INPUT)), np.ones((5, 3), bool)
    mask[3:, 1] = False
    run = lambda: net.forward(net.gates(x), mask, keep=True)
    logits, cache = run()
    g, _ = net.backward(np.ones(3), x, mask, cache)
    for name in ("f_x", "b_h", "attend", "out", "f_b"):
        flat, at = net.w[name].ravel(), 1
        before, h = flat[at], 1e-2
        flat[at] = before + h
        up = run()[0].sum()
        flat[at] = before - h
        down = run()[0].sum()
        flat[at] = before
        assert g[name].ravel()[at] == pytest.approx((up - down) / (2 * h), rel=0.05, abs=2e-3)


def test_nearest_is_exact_on_small_tables(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 12)).tolist()
    v[7], v[8], v[9], v[10], v[11] = None, [0.0] * 12, [float("nan")] * 12, [1.0] * 5, [None, *[1.0] * 11]
    for k in range(100, 220):
        v[k] = v[100]  # a frequent vector
    rows = [(k, x, "z") for k, x in enumerate(v)] + [(50, v[50], "again")] * 9 + [(None, v[3], "z")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    rows = ann.nearest(table, F.col("vec_id") % 50 == 0, recall=1.0).collect()
    good = [k for k in range(400) if k not in (7, 8, 9, 10, 11)]
    unit = {k: np.array(v[k]) / np.linalg.norm(v[k]) for k in good}
    for q in range(0, 400, 50):
        want = sorted(((-round(float(unit[q] @ unit[k]), 12), k) for k in good if k != q))[:5]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        assert [g[1] for g in got] == [k for _, k in want] and [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert [g[2] for g in got] == pytest.approx([-s for s, _ in want])
    few = ann.nearest(table.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert ann.nearest(table.filter("vec_id = 8"), F.lit(True)).count() == 0


def test_nearest_of_many(spark, monkeypatch):
    """Most of the nearest are found although few lists are visited and few vectors compared; shards and blocks are cut."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    v = (centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 24))).astype(np.float32)
    table = spark.createDataFrame([(k, x) for k, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    index = ann.fit(u, ann.lists_for(4000))
    assert len(index.centroids) == 63 and index.visits < 20
    for shard, block in ((ann.SHARD, ann.BLOCK), (50, 7)):
        monkeypatch.setattr(ann, "SHARD", shard)
        monkeypatch.setattr(ann, "BLOCK", block)
        rows = ann.nearest(table, F.col("vec_id") % 50 == 0).collect()
        found = 0
        for q in range(0, 4000, 50):
            likeness = u @ u[q]
            likeness[q] = -2
            mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
            assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and [m[2] for m in mine] == pytest.approx([likeness[m[1]] for m in mine])
            found += len({m[1] for m in mine} & set(np.argsort(-likeness)[:5].tolist()))
        assert found >= 0.95 * 80 * 5


def test_link_rank(spark):
    page = lambda *links: "".join(f'<a href="{u}">x</a>' for u in links)
    rows = [
        (0, "http://Good.com/ok/1", page("http://friend.com/", "//friend.com/x", "/local")),
        (1, "http://friend.com/a?b#c", None),
        (2, "http://bad.net/spam/1", ""),
        (3, "http://fan.org/x", page("https://bad.net/spam/2")),
        (4, None, None),
        (5, "no scheme", page("http://bad.net")),
        (6, "http://sub.bad.net/spam?x=http://good.com/ok", ""),
        (6, "http://sub.bad.net/spam?x=http://good.com/ok", ""),
        (7, "http://bad.network/spam/", ""),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("page_id", "Host")
    rules = [linkrank.Rule("allow", "good.com/ok"), linkrank.Rule("block", "bad.net/spam"), linkrank.Rule("allow", "bad.net/spam/1/fine")]
    from pyspark.sql import functions as F

    out = {r["page_id"]: r for r in linkrank.judged(table.withColumnRenamed("Host", "page_id").withColumn("verdict", F.lit("old")), rules).collect()}
    assert (out[0]["host"], out[0]["path"], out[0]["rule"], out[0]["verdict"]) == ("good.com", "/ok/1", "good.com/ok", "allow")
    assert (out[1]["host"], out[1]["path"], out[1]["rule"], out[1]["verdict"]) == ("friend.com", "/a", None, "allow") and out[1]["trust"] > 0
    assert out[3]["verdict"] == "block" and out[3]["distrust"] > 0 and out[3]["rule"] is None
    assert (out[4]["host"], out[4]["path"], out[4]["verdict"]) == ("", "", "allow") and out[5]["host"] == ""
    assert out[6]["rule"] == "bad.net/spam" and out[7]["rule"] is None
    edges, seeds = {("a", "b"): 2.0, ("a", "c"): 1.0, ("b", "c"): 1.0, ("c", "a"): 1.0}, {"a": (1.0, 0.0), "c": (0.0, 1.0)}
    got = linkrank.propagated(spark.createDataFrame([(*k, w) for k, w in edges.items()], "a string, b string, weight double"), spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double"), error=1e-10)
    t = d = None
    for which in (0, 1):
        score = {h: s[which] for h, s in seeds.items() if s[which]}
        flow = edges if not which else {(b, a): w for (a, b), w in edges.items()}
        for _ in range(200):
            new = Counter()
            for (a, b), w in flow.items():
                new[b] += 0.85 * score.get(a, 0) * w / sum(x for (p, _), x in flow.items() if p == a)
            for h, s in seeds.items():
                new[h] += (1 - sum(0.85 * score.get(x, 0) for x in "abc")) * s[which]
            score = new
        t, d = (score, d) if not which else (t, score)
    for r in got.collect():
        assert (r["trust"], r["distrust"]) == (pytest.approx(t[r["host"]], abs=1e-6), pytest.approx(d[r["host"]], abs=1e-6))


def test_verdicts_against_brute_force(spark):
    """Pages that link to each other's hosts; every score and verdict from the stated rules, plainly."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    hosts = [f"h{k}.site{k % 5}.org" for k in range(14)] + ["site1.org", "a.co.uk", "b.co.uk", "x.a.co.uk:80", "10.0.0.1", "11.0.0.1", "me@site2.org", "Q.net", "deep.Q.net", ".".join(["l"] * 90)]
    rows = []
    for k in range(120):
        links = "".join(f"<A HREF='http://{rng.choice(hosts)}/p{k}'>" for _ in range(rng.randrange(4)))
        rows.append((k, f"http://{rng.choice(hosts)}/{rng.choice(['good', 'bad', 'other'])}/{k}", links if k % 7 else None, "old"))
    rows += [(120, "http://h1.site1.org/" + "x" * 100_000, None, "old"), (121, None, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, of_trust string").withColumns({"rule_found": F.lit(1), "of_distrust": F.lit(2), "OF_HOST": F.lit(3)})
    rules = [linkrank.Rule("allow", "org/good"), linkrank.Rule("block", "site2.org/bad"), linkrank.Rule("block", "net/bad"), linkrank.Rule("allow", "co.uk/good")]
    out = {r["page_id"]: r for r in linkrank.judged(table, rules).collect()}
    assert len(out) == len(rows) and set(table.columns) <= set(linkrank.judged(table, rules).columns)

    def parts(url):
        rest = url.split("://", 1)[1]
        host, slash, path = rest.partition("/")
        return host.lower(), slash + path

    def rule_of(host, path):
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.text), default=None)

    pages = {k: parts(u) for k, u, _, _ in rows if u}
    of = {k: rule_of(*p) for k, p in pages.items()}
    known = {h for h, _ in pages.values()}
    edges = Counter()
    for k, u, html, _ in rows:
        for target in (html or "").split("HREF='")[1:]:
            a, b = pages[k][0], parts(target.split("'")[0])[0]
            if a != b:
                edges[a, b] += 1
    near = set()
    for h in known:
        name = h.split("@")[-1].split(":")[0]
        if name[0].isdigit():
            continue
        labels = name.split(".")
        above = [".".join(labels[k:]) for k in range(len(labels))]
        up = next((x for x in above if x != h and x in known), None)
        site = ".".join(labels[-3:] if name.endswith(".co.uk") else labels[-2:])
        near |= {(h, x) for x in (up, site) if x and x != h}
    for a, b in near | {(b, a) for a, b in near}:
        edges[a, b] += 1
    score = {}
    for kind, flow in (("allow", edges), ("block", {(b, a): w for (a, b), w in edges.items()})):
        seed = {h: sum(of[k] is not None and of[k].verdict == kind for k in pages if pages[k][0] == h) / sum(p[0] == h for p in pages.values()) for h in known}
        total = sum(seed.values())
        seed = {h: s / total for h, s in seed.items()}
        out_of = Counter()
        for (a, _), w in flow.items():
            out_of[a] += w
        now = dict(seed)
        for _ in range(300):
            new = Counter()
            for (a, b), w in flow.items():
                new[b] += 0.85 * now.get(a, 0) * w / out_of[a]
            rest = 1 - sum(new.values())
            for h, s in seed.items():
                new[h] += rest * s
            now = new
        score[kind] = now
    for k, (host, path) in pages.items():
        trust, distrust = score["allow"].get(host, 0), score["block"].get(host, 0)
        assert (out[k]["host"], out[k]["path"]) == (host, path)
        assert (out[k]["trust"], out[k]["distrust"]) == (pytest.approx(trust, abs=2e-3), pytest.approx(distrust, abs=2e-3))
        if of[k] or abs(trust - distrust) > 4e-3:
            assert out[k]["verdict"] == (of[k].verdict if of[k] else "block" if distrust > trust else "allow")
    assert {r["verdict"] for r in out.values() if r["rule"] is None} == {"allow", "block"}
    assert linkrank.judged(table.limit(0), rules).count() == 0


def test_rules_in_an_expression_and_in_a_join(spark, monkeypatch):
    rng = random.Random(8)
    label = lambda: rng.choice(["a", "b", "bb", "com", "ä", ""])
    name = lambda n: ".".join(label() for _ in range(rng.randrange(1, n)))
    rules = [linkrank.Rule(rng.choice(["allow", "block"]), f"{name(4)}/{''.join(rng.choices('xyü/', k=rng.randrange(1, 4)))}") for _ in range(150)]
    rules += [linkrank.Rule("allow", "a.com/xxxx"), linkrank.Rule("block", "com/xxxxxx"), linkrank.Rule("block", "a.com/xxxx"), linkrank.Rule("block", "bare.com")]
    urls = [(name(6), "/" + "".join(rng.choices("xyü/", k=rng.randrange(6)))) for _ in range(400)] + [("a.com", "/xxxxxx"), ("www.bare.com", ""), ("", ""), ("", "/x"), (".", "/"), ("x" * 9000 + ".bare.com", "/" + "y" * 9000)]
    urls += urls[:5]

    def best(host, path):
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        found = max(fits, key=lambda r: len(r.text), default=None)  # of equally long ones the first
        return found and (found.text, found.verdict)

    table = spark.createDataFrame([(k, *u) for k, u in enumerate(urls)], "page_id long, host string, path string")
    want = {k: best(*u) for k, u in enumerate(urls)}
    assert sum(w is None for w in want.values()) > 20 and len(set(want.values())) > 30
    for most in (2000, 0):
        monkeypatch.setattr(linkrank, "MOST_RULES", most)
        got = linkrank.with_rules(table, rules, "found").collect()
        assert len(got) == len(urls) and {r["page_id"]: r["found"] and tuple(r["found"]) for r in got} == want
    pages = spark.createDataFrame([(1, "http://www.bare.com/x", None), (2, None, ""), (2, None, ""), (3, "https://other.org", "")], "rule_host long, url string, html string")
    out = linkrank.judged(pages, rules[-4:]).orderBy("rule_host").collect()
    assert [(r["rule_host"], r["rule"]) for r in out] == [(1, "bare.com"), (2, None), (2, None), (3, None)]


def test_transcripts(spark, monkeypatch):
    rows = [(1, k, f"{'User' if k % 2 == 0 else 'Assistant'}: line {k}{'?' if k % 2 == 0 else ''}") for k in range(23)]
    rows += [(2, 0, "System: be brief"), (2, 1, "Speaker 1: hi"), (2, 2, None), (2, 2, None), (None, None, ""), (None, 1, "User: x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    model = transcript.trained(table.limit(0).selectExpr("*", "'user' as role"))
    whole = transcript.parsed(table, model).collect()
    assert len(whole) == len(rows)
    first = sorted((r for r in whole if r["conv_id"] == 1), key=lambda r: r["turn"])
    assert [r["role"] for r in first] == ["user" if k % 2 == 0 else "assistant" for k in range(23)]
    assert first[0]["rendered"] == "<|user|>\nline 0?\n<|end|>\n"
    monkeypatch.setattr(transcript, "BLOCK", 2)  # conversations now cross many blocks
    key = lambda r: (str(r["conv_id"]), str(r["turn"]), r["role"], r["rendered"])
    assert sorted(map(key, transcript.parsed(table, model).collect())) == sorted(map(key, whole))
    assert transcript.parsed(table.limit(0), model).count() == 0
    assert transcript.lines(spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string")).count() == 2


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(1)
    n = len(transcript.ROLES)
    share = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    for length in (1, 2, 3, 6, 7):
        model = transcript.Model(share(rng.random(n)), share(rng.random((n, n))), ())
        emitted = np.log(rng.random((length, n)))

        def value(path, model=model, emitted=emitted):
            return model.start[path[0]] + sum(model.move[a, b] for a, b in zip(path, path[1:])) + sum(emitted[k, r] for k, r in enumerate(path))

        best = max(product(range(n), repeat=length), key=value)
        assert tuple(transcript.viterbi(model, emitted)) == best
        m = transcript.transfer(model, emitted)
        for first, last in product(range(n), repeat=2):
            paths = [p for p in product(range(n), repeat=length) if p[0] == first and p[-1] == last]
            want = max((value(p) - model.start[first] for p in paths), default=-np.inf)
            assert m[first, last] == pytest.approx(want)
            if paths:
                assert tuple(transcript.viterbi(model, emitted, first, last)) == max(paths, key=value)


def test_lines_without_marker_stay_in_their_turn(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for c in range(6):
        n = 5000 if c == 5 else 300  # the last one crosses blocks of the real size
        k, role = 0, 0
        while k < n:
            who = ("user", "assistant")[role % 2]
            for line in range(rng.choice((1, 1, 2, 3, 5))):
                rows.append((c, k, ("" if line else who.title() + ": ") + "same words", who, "a", "b", 1, 2, "x"))
                k += 1
            role += 1
    fields = "conv_id long, turn long, text string, role string, rendered string, f string, h int, block int, name string"
    table = spark.createDataFrame(rows, fields)
    labelled = spark.createDataFrame([(c, t, "\n".join([("User: ", "Assistant: ")[t % 2] + "same words", *["same words"] * (c % 5)]), ("user", "assistant")[t % 2]) for c in range(10) for t in range(6)], "conv_id long, turn long, text string, role string")
    model = transcript.trained(labelled)
    want = {(c, k): who for c, k, _, who, *_ in rows}
    found = transcript.parsed(table, model).collect()
    assert {(r["conv_id"], r["turn"]): r["role"] for r in found} == want and len(found) == len(rows)
    ordered = sorted(found, key=lambda r: (r["conv_id"], r["turn"]))
    begins = [a["conv_id"] != b["conv_id"] or a["role"] != b["role"] for a, b in zip(ordered, ordered[1:])]
    assert [r["starts_turn"] for r in ordered] == [True, *begins] and [r["ends_turn"] for r in ordered] == [*begins, True]
    monkeypatch.setattr(transcript, "BLOCK", 1 << 20)
    assert sorted(map(str, transcript.parsed(table, model).collect())) == sorted(map(str, found))
    unlabelled = transcript.trained(labelled.limit(0))  # pseudo-counts alone keep unmarked lines in their turn
    assert {(r["conv_id"], r["turn"]): r["role"] for r in transcript.parsed(table.filter("conv_id < 2"), unlabelled).collect()} == {k: w for k, w in want.items() if k[0] < 2}


def test_roles_of_raw_transcripts(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(2, 9)):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[(t + (c % 3 == 0)) % 2]
            n = 1 if role == "user" else rng.randrange(1, 5)
            rows.append((c, t, role, "\n".join(" ".join(rng.choices("abc def ghij klmno".split(), k=5 if role == "user" else 40)) for _ in range(n)), "x"))
    rows += [(None, None, None, None, "x"), (99, 0, "narrator", "", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, line string")
    raw = transcript.marked(table)
    assert raw.columns == table.columns and raw.count() == len(rows)
    model = transcript.trained(raw.filter("conv_id < 40"))
    found = transcript.recovered(raw, model).collect()
    role = {(c, t): r for c, t, r, _, _ in rows}
    assert len(found) == sum((t or "").count("\n") + 1 for *_, t, _ in rows)
    held = [r for r in found if r["conv_id"] is not None and 40 <= r["conv_id"] < 60]
    assert sum(r["role"] == role[r["conv_id"], r["turn"]] for r in held) >= 0.95 * len(held)
    one = sorted((r for r in found if r["conv_id"] == 41), key=lambda r: (r["turn"], r["line"]))
    text = "".join(r["rendered"] for r in one)
    assert text.count("<|end|>") == sum(r["starts_turn"] for r in one) == sum(r["ends_turn"] for r in one) and "User:" not in text
    monkeypatch.setattr(transcript, "BLOCK", 3)
    key = lambda r: str((r["conv_id"], r["turn"], r["line"], r["role"], r["rendered"]))
    assert sorted(map(key, transcript.recovered(raw, model).collect())) == sorted(map(key, found))
    assert transcript.recovered(raw.limit(0), model).count() == 0
