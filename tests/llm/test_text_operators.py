"""Each text operator against brute force on a small fixture with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from locusframe.llm import bpe, decontam, fingerprint, jaccard, langid, pii, quality, ranges, sharding, toxicity, urlfilter
from locusframe.llm.queries import URL_RULES, tokenizer_path
from locusframe.runtime import Scratch, ship

rng = np.random.default_rng(5)
SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]


def prose(words: int, seed: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(SYLLABLES, r.integers(1, 4))) for _ in range(words))


def texts() -> list[str | None]:
    base = prose(120, 1)
    near = base.replace(base.split()[60], "changed", 1)
    out = [None, "", "   \n\t ", "one", "one two", "One TWO", base, base, near, base + " tail", prose(400, 2), prose(3000, 3), "x" * 5000, "é ß İ 中文 " * 30, "a\x00b \U0001f600 c", "mail me: a.b@c-d.org or +1 (555) 555-0199, 10.0.0.1; card 4111 1111 1111 1111!"]
    out += [prose(60, 10), " ".join(prose(60, 10).split()[:59]) + " z", prose(9, 4), prose(9, 4)]
    return out


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, id string, n string, c string, shard string, items string, `a b` int"


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    t = texts()
    ids = [*range(len(t) - 1), None]
    rows = [(i, x, "en" if k % 2 else None, None, len(x or ""), "s", "i", "n", "c", "h", "t", k) for k, (i, x) in enumerate(zip(ids, t, strict=True))]
    rows.append(rows[6])  # a repeated row
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def all_texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


# 1


def test_bpe_is_the_librarys(docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    got = bpe.encode_documents(docs, tokenizer_path())
    assert got.count() == docs.count()
    found = by_id(got)
    for i, t in all_texts(docs):
        ids = lib.encode(t, add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        r = found[i]
        assert (r["ids"], r["decoded"], r["n_tokens"]) == (ids, text, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(none, tokenizer_path()).count() == 0


def test_bpe_tree_joins_are_exact():
    enc = bpe.Encoder(tokenizer_path(), leaf=2, cache_bytes=5000)
    r = np.random.default_rng(0)
    weird = ["don't 'S 'll''ve x'", "<|startoftext|>a<|endoftext|>", "Σ́σς ﬁ q\x1cz\x85", "a" * 3000, "12345" * 9, "x" * 300 + "é" * 300]
    weird += ["".join(r.choice(list("theingrdo'nxw é!9"), r.integers(1, 400))) for _ in range(150)]
    weird += ["".join(r.choice(SYLLABLES, 200)) for _ in range(20)]
    ids, at, text, to = enc.encode(pa.array([*weird, None, ""]))
    for k, t in enumerate([*weird, "", ""]):
        want = enc.library.encode(t, add_special_tokens=False).ids
        assert ids[at[k] : at[k + 1]].tolist() == want and text[to[k] : max(to[k], to[k + 1] - 1)].tobytes().decode() == enc.library.decode(want, skip_special_tokens=False)
    assert enc.trees > 20


def test_words_in_the_cache_are_bounded_by_bytes():
    enc = bpe.Encoder(tokenizer_path(), cache_bytes=20_000)
    for k in range(30):
        enc.encode(pa.array([prose(50, k), "y" * 100_000]))
        assert enc.held <= 10_000 and sum(map(len, enc.new)) + sum(map(len, enc.old)) <= 10_000


# 2


def check_shards(rows, shards):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(r["size"] for r in by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def test_shards_are_even(spark, docs, none):
    rows = sharding.shard(docs, 3).collect()
    assert len(rows) == docs.count()
    check_shards(rows, 3)
    t = dict(all_texts(docs))
    assert all(r["size"] == len(t[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(t[r["doc_id"]].encode()) for r in rows)
    assert sharding.shard(none, 3).count() == 0
    hot = spark.range(900).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same text', concat('text ', id)) AS text")
    rows = sharding.shard(hot, 24).collect()
    assert len(rows) == 900
    check_shards(rows, 24)


@pytest.mark.parametrize("law", ["id % 3 = 0, repeat('a hot text ', 40), concat('text ', id)", "id % 2 = 0, CAST(NULL AS STRING), repeat(CAST(id AS STRING), 30)", "id = 7, repeat('very long ', 20000), concat('t', id % 11)"])
def test_shards_by_brute_force(spark, law):
    """In order of shard and slot equal texts stand together, and each row's place in bytes gives its shard."""
    frame = spark.range(1500).selectExpr("id AS doc_id", f"IF({law}) AS text").repartition(5)
    t = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
    rows = sorted(sharding.shard(frame, 24).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert sorted(r["doc_id"] for r in rows) == list(range(1500))
    met, last = set(), None
    for r in rows:
        if t[r["doc_id"]] != last:
            last = t[r["doc_id"]]
            assert last not in met
            met.add(last)
    total, before, slots = sum(r["size"] for r in rows), 0, collections.Counter()
    for r in rows:
        assert r["size"] == len(t[r["doc_id"]].encode()) + 8 and r["slot"] == slots[r["shard"]]
        assert r["shard"] == min(23, int((before + r["size"] / 2) * 24 / total))
        before, slots[r["shard"]] = before + r["size"], slots[r["shard"]] + 1


def test_hot_keys_get_ranges_of_their_own(spark):
    rows = spark.range(6000).selectExpr("id", "IF(id % 5 < 2, 77L, id * 9973) AS a", "id AS b", "1.0D AS load")
    bounds = sharding.splitters(rows, 16)
    assert 77 in bounds and 78 in bounds
    sizes = collections.Counter(r["r"] for r in rows.selectExpr(f"{ranges.range_id('a', bounds)} AS r").collect())
    assert sorted(sizes.values())[-1] == 2400 and sorted(sizes.values())[-2] <= 1.5 * 6000 / 16


def test_placement_deals_groups_in_turn(spark):
    from pyspark.sql import functions as F

    for groups, parts in ((5, 8), (40, 7), (211, 211)):
        values = ranges.placement(spark, groups, parts)
        assert len(set(values)) == groups
        frame = spark.createDataFrame(list(enumerate(values)), "g int, v int").withColumn("p", F.pmod(F.hash("v"), F.lit(parts)))
        assert all(r["p"] == r["g"] % parts for r in frame.collect())


# 3


def naive_kneser_ney(train: list[np.ndarray], order: int):
    """Recursive textbook form over n-grams as tuples, discounts from counts of counts."""
    levels = {order: collections.Counter(itertools.chain.from_iterable(train))}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    held = {k: quality._discounts([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]) for k, c in levels.items()}

    def p(g):
        if not g:
            return 1 / 256
        c = levels[len(g)]
        same = {x: n for x, n in c.items() if x[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total = sum(same.values())
        d = held[len(g)]
        left = sum(d[min(n, 3) - 1] for n in same.values())
        seen = max(same[g] - d[min(same[g], 3) - 1], 0) if g in same else 0.0
        return (seen + left * p(g[1:])) / total

    return p


def unpacked(column):
    grams, of = quality.packed(column)
    return [[tuple(g >> 8 * k & 255 for k in range(quality.ORDER - 1, -1, -1)) for g in grams[of == r].tolist()] for r in range(len(column))]


def test_quality_model_is_kneser_ney(spark):
    ship(spark)
    good = [prose(30, k) for k in range(6)]
    rows = [(i, "en", t) for i, t in enumerate([*good, "", "ZZ!! 99 ## qq", prose(30, 99)])]
    docs = spark.createDataFrame(rows, "id long, lang string, text string")
    trusted = spark.createDataFrame([("en", t) for t in good], "lang string, text string")
    found = {r["id"]: r for r in quality.log_probabilities(docs, trusted).collect()}
    p = naive_kneser_ney(unpacked(pa.array(good)), quality.ORDER)
    for (i, _, t), grams in zip(rows, unpacked(pa.array([r[2] for r in rows])), strict=True):
        assert found[i]["events"] == len(t) + 1 == len(grams)
        assert found[i]["log_prob"] == pytest.approx(sum(np.log(p(g)) for g in grams), rel=1e-9)


def test_quality_keeps_good_text(spark, docs, none):
    good = [(k, prose(80, k), "en") for k in range(200)]
    bad = [(1000 + k, "### $$$ %%% 12 " * 30, "en") for k in range(5)]
    frame = spark.createDataFrame([*good, *bad, (2000, None, None), (2000, None, None)], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(k,) for k in range(150)], "doc_id long")
    rows = quality.classify(frame, trusted).collect()
    assert len(rows) == frame.count()
    assert not any(r["keep"] for r in rows if 1000 <= r["doc_id"] < 2000)
    assert sum(r["keep"] for r in rows if r["doc_id"] < 1000) == 200
    assert all(r["keep"] and r["threshold"] is None for r in rows if r["doc_id"] == 2000)
    assert quality.classify(docs, trusted.limit(0)).count() == docs.count()
    assert quality.classify(none, trusted).count() == 0


def test_rare_languages_have_thresholds(spark):
    """Trusted documents of which the remainder holds out none, and a language with but one."""
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5]
    held = next(k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0)
    es, one = ids[:40], ids[40]
    bad = "### $$$ %%% 12 " * 30
    frame = spark.createDataFrame([*((k, prose(200, k), "es") for k in es), (1000, bad, "es"), (one, prose(200, 7), "fr"), (1001, bad, "fr"), (held, prose(200, 9), "en"), (ids[41], prose(200, 10), "en"), (1002, bad, "xx")], "doc_id long, text string, lang string")
    rows = by_id(quality.classify(frame, spark.createDataFrame([(k,) for k in [*es[:20], one, held, ids[41]]], "doc_id long")))
    assert len(rows) == frame.count()
    assert all(rows[k]["keep"] for k in es) and not rows[1000]["keep"]
    assert rows[one]["threshold"] is not None and not rows[1001]["keep"]
    assert rows[1002]["threshold"] is None and rows[1002]["keep"]


def test_many_languages_are_scored_in_groups(spark):
    frame = spark.createDataFrame([(k, f"l{k % 5}", prose(30, k)) for k in range(40)], "id long, lang string, text string")
    trusted = frame.where("id < 24 AND lang <> 'l4'").select("lang", "text")
    one, many = (sorted((r["id"], r["lang"], r["events"], round(r["log_prob"], 9)) for r in quality.log_probabilities(frame, trusted, most).collect()) for most in (64, 2))
    assert one == many and len(one) == 40


def test_postings_round_trip():
    grams = np.sort(rng.integers(0, 50, 5000))
    docs = rng.integers(0, 500, 5000)
    counts = rng.integers(1, 400, 5000)
    names, place, d, n = quality.unpack(quality.pack(grams, docs, counts))
    assert (names[place] == grams).all() and (d == docs).all() and (n == counts).all()


# 4


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(t):
    out = []
    for k, (kind, p) in enumerate(KINDS):
        for m in re.finditer(p, t):
            d = [int(c) for c in re.sub("[^0-9]", "", m.group())]
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    r = np.random.default_rng(2)
    parts = ["a.b@c.de", "@", "x@y", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-0199", "+12", " ", "..", "é", "-", "0004.5.6.7"]
    for _ in range(1500):
        t = "".join(r.choice(parts, r.integers(0, 9)))
        assert pii.base_spans(t) == plain_spans(t)


@pytest.mark.parametrize("text", ["0" * 5000 + ".1.1.1", "1" * 1_000_000, "a" * 1_000_000 + "@", "1 " * 300_000, "1.1." * 200_000, "+1" + " " * 1_000_000, "a@" * 300_000, "x" * 1_000_000, "a.b@c.d " * 50_000, "@" + "a" * 500_000 + "."], ids=lambda t: t[-8:])
def test_long_runs_take_linear_time(text):
    """A million digits, zeros, one-run addresses: seconds, and no more than three times as long for twice the text."""
    took = []
    for t in (text, text + text):
        start = time.time()
        pii.Nodes(t, pii.base_spans(t))
        took.append(time.time() - start)
    assert took[0] < 10 and took[1] < 4 * took[0] + 1
    short = text[:60] + text[-60:]
    assert pii.base_spans(short) == plain_spans(short)


def test_marginals_are_those_of_the_field():
    """Sum-product against enumeration of all labellings: equal without loops, near with them."""
    r = np.random.default_rng(4)
    for t, loops in (("12345 777 +1 (555) 555-0199 88", False), ("1234567 22 1234567", True), ("+1 (555) 555-0199 or 15555550199 and 99 then 15555550199", True)):
        n = pii.Nodes(t, pii.base_spans(t))
        field = pii.Field(0.4 * r.normal(size=(pii.SHAPES, 5)), 0.4 * r.normal(size=(5, 5)), np.diag([0.5, 0.7, 0.2, 0.4, 0.8]))
        unary, m = n.shapes() @ field.nodes, len(n.texts)
        want, skips = np.zeros((m, 5)), n.skips()
        for y in itertools.product(range(5), repeat=m):
            if all(seen in (0, k) for seen, k in zip(n.labels, y, strict=True)):
                w = np.exp(sum(unary[i, k] for i, k in enumerate(y) if not n.labels[i]) + sum(field.chain[a, b] for a, b in zip(y, y[1:])) + sum(field.skip[y[i], y[j]] for i, j in skips))
                want[range(m), y] += w
        want /= want.sum(1, keepdims=True)
        assert np.abs(field.marginals(n) - want).max() < (0.06 if loops else 2e-3)


def test_field_is_learned_by_pseudo_likelihood():
    """The gradient of the penalised pseudo-likelihood vanishes at the learned potentials, and kinds repeat."""
    sample = [f"call +1 (555) 555-{k:04d} or {k}1 items, again +1 (555) 555-{k:04d}" for k in range(50)] + [f"order {k:03d}-555-321-9 and 99" for k in range(50)]
    counts = pii.statistics(sample)
    f, g = pii.Field.learned(counts, 4000), pii.Field.learned(counts, 4400)
    assert np.abs(f.nodes - g.nodes).max() < 1e-2 and np.abs(f.skip - g.skip).max() < 1e-2
    assert f.skip[4, 4] > 1 and f.nodes[12, 4] > f.nodes[12, 0]  # a plus sign


def test_planted_repeats_are_found_and_others_left():
    """Numbers that repeat an observed one in another form, and as many that repeat none."""
    r = np.random.default_rng(8)
    num = lambda: f"{r.integers(200, 999)}{r.integers(200, 999)}{r.integers(1000, 9999)}"
    texts_, forms = [], lambda x: [f"1{x}", f"1-{x[:3]}-{x[3:6]}-{x[6:]}", x]
    for k in range(200):
        x, other = num(), num()
        again, free = forms(x)[k % 3], forms(other)[k % 3]
        texts_.append((f"ring +1{x} today. {prose(30, k)} so {again} it was, not {free} {prose(5, k + 1)}", again, free))
    field = pii.Field.fit([t for t, _, _ in texts_])
    found = left = 0
    for t, again, free in texts_:
        got = {t[a:z] for a, _, z in field.added(t, pii.base_spans(t))}
        found, left = found + (again in got), left + (free not in got)
    assert found >= 190 and left >= 190


def test_personal_data(docs, none):
    field = pii.fit(docs)
    rows = pii.detect(docs, field).collect()
    assert len(rows) == docs.count()
    t = dict(all_texts(docs))
    for r in rows:
        want = plain_spans(t[r["doc_id"]])
        assert r["base_spans"] == ",".join(f"{KINDS[k][0]}:{a}:{z}" for a, k, z in want)
        assert r["base_sha256"] == hashlib.sha256(r["base_spans"].encode()).hexdigest()
        assert set(r["base_spans"].split(",")) - {""} <= set(r["spans"].split(","))
    clean = pii.redact(docs, field)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    hit = next(r for r in clean.collect() if r["text"] and "mail me" in r["text"])
    assert "a.b@c-d.org" not in hit["text"] and "[EMAIL]" in hit["text"] and hit["n_chars"] == len(hit["text"])
    assert pii.detect(none, field).count() == 0 and pii.redact(none, field).count() == 0


def test_skip_edges_spread_labels():
    sample = [f"call +1 (555) 555-{k:04d} or {k}1 items, number {k}2345, again +1 (555) 555-{k:04d}" for k in range(300)] + [f"card 4111 1111 1111 1111 and 1234567{k:09d}" for k in range(100)] + [f"order {k:03d}-555-321-9 and {k:03d}-21" for k in range(300)]
    field = pii.Field.fit(sample)
    t = "reach +1 (663) 555-6869 now; later 1-663-555-6869 again, and 987-654-321-0 not"
    base = pii.base_spans(t)
    added = field.added(t, base)
    assert [t[a:z] for a, _, z in added] == ["1-663-555-6869"] and added[0][1] == 3
    assert field.added("only 1234 and 99 here", []) == []
    t = "card 4111 1111 1111 1111, later 4111111111111111 4111111111111111 in a row"  # too long for the pattern together
    assert [t[a:z] for a, _, z in field.added(t, pii.base_spans(t))] == ["4111111111111111"] * 2


def test_repeats_at_any_distance():
    """All repeats of an observed number are found, by few edges, and messages run until they settle."""
    sample = [f"call +1 (555) 555-{k:04d} or {k}1 items, number {k}2345, again +1 (555) 555-{k:04d}" for k in range(300)] + [f"order {k:03d}-555-321-9 and {k:03d}-21" for k in range(300)]
    field = pii.Field.fit(sample)
    for times in (20, 60):
        t = "reach +16635556869 now; " + "then 16635556869 or item 12, " * times
        base = pii.base_spans(t)
        assert [t[a:z] for a, _, z in field.added(t, base)] == ["16635556869"] * times
        n = pii.Nodes(t, base)
        assert len(n.skips()) <= 3 * len(n.keys)
    n = pii.Nodes("16635556869 12345 " * 30, [])  # a chain without an observed token
    n.labels[0] = 4
    field.nodes[:] = 0
    field.skip = 8.3 * np.eye(5)
    assert field.marginals(n)[::2, 4].min() > 0.9


def test_parts_of_any_observed_token():
    """A contact list of 100 numbers; parts of 8 to 13 characters, of early and late ones."""
    r = np.random.default_rng(3)
    numbers = [x for x in (f"{k}{r.integers(10**12, 10**13)}" for k in range(10, 99) for _ in range(2)) if not pii.luhn(x)][:100]
    lines = "\n".join(f"name +{x};" for x in numbers)
    for k in (0, 63, 64, 99):
        for size in range(8, 14):
            for part in (numbers[k][:size], numbers[k][-size:], numbers[k][2 : 2 + size]):
                t = f"{lines}\nlocal {part} there"
                n = pii.Nodes(t, pii.base_spans(t))
                assert n.labels.tolist() == [4] * 100 + [0] and n.keys[-1] == part
                assert (k, 100) in n.skips()
    t = f"{lines}\nlocal 12345678 and {numbers[0][-4:]}{numbers[1][:6]} and {numbers[0][:7]}"  # nobody's part, or too short
    assert not pii.Nodes(t, pii.base_spans(t)).held()


def test_field_learns_from_whole_texts(spark):
    """Personal data behind 20,000 characters counts like any other."""
    ship(spark)
    late = [f"{'word ' * 4200}call +1 (555) 555-{k:04d} or {k}1 items, number {k}234567, again +1 (555) 555-{k:04d}" for k in range(40)]
    field, want = pii.fit(spark.createDataFrame([(t,) for t in late], "text string")), pii.Field.fit(late)
    assert np.allclose(field.nodes, want.nodes) and np.allclose(field.chain, want.chain) and np.allclose(field.skip, want.skip)
    assert np.abs(field.nodes[:, 4]).max() > 0.1


# 5


def test_fingerprints(spark, docs, none):
    rows = docs.select("doc_id", "text").collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    got = fingerprint.with_edits(docs).collect()
    assert len(got) == len(rows)
    sha = collections.Counter()
    for k, r in enumerate(order):
        t, n = r["text"] or "", order[(k + 1) % len(order)]["text"] or ""
        q = len(t) // 4
        sha[(r["doc_id"], len(t), hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest())] += 1
    assert sha == collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got)
    same = {r["fingerprint"] for r in got if r["doc_id"] in (6, 7)}
    assert len(same) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprint.with_edits(none).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    assert fingerprint.with_edits(one).first()["near_next"] == 1.0


def test_fingerprints_of_any_ids(spark):
    """String ids, in their order; and the query's columns recomputed from sketches of the texts."""
    texts_ = [prose(40 + 7 * k, 60 + k) for k in range(12)] + ["", None, "a b"]
    ids = [f"k{k:03d}" if k != 5 else None for k in range(len(texts_))]
    frame = spark.createDataFrame(list(zip(ids, texts_, strict=True)), "doc_id string, text string").repartition(4)
    got = {r["doc_id"]: r for r in fingerprint.with_edits(frame).collect()}
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or ""))
    made = []
    for place, k in enumerate(order):
        t, n = texts_[k] or "", texts_[order[(place + 1) % len(order)]] or ""
        made.append((ids[k], t, t[: len(t) - len(t) // 4] + n[: len(t) // 4], n))
    plain = spark.createDataFrame(made, "id string, t string, e string, n string").select("id", *[fingerprint.sketch(c).alias(c) for c in "ten"]).collect()
    for r in plain:
        hexed = lambda s: "".join(f"{h & (1 << 64) - 1:016x}" for h in s)
        x = got[r["id"]]
        assert (x["fingerprint"], x["edited_fingerprint"]) == (hexed(r["t"]), hexed(r["e"]))
        for a, b, near in ((r["t"], r["e"], x["near_edited"]), (r["t"], r["n"], x["near_next"])):
            top = min((s[-1] if len(s) == fingerprint.K else 1 << 63) for s in (a, b)) if a or b else 0
            both, either = ({h for h in f(set(a), set(b)) if h <= top} for f in (set.intersection, set.union))
            assert near == pytest.approx(len(both) / len(either) if either else 1.0)


def shingles(t, k=5):
    w = t.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_sketch_estimates(spark):
    a, b = prose(900, 7), " ".join(prose(900, 7).split()[:600] + prose(300, 8).split())
    row = spark.createDataFrame([(a, b)], "a string, b string").withColumns({"x": fingerprint.sketch("a"), "y": fingerprint.sketch("b")})
    got = row.select(fingerprint.resemblance("x", "y").alias("r"), fingerprint.containment("x", "y").alias("c"), fingerprint.distinct_count("x").alias("n"), fingerprint.merge("x", "y").alias("m"), fingerprint.sketch("concat(a, ' ', b)").alias("both")).first()
    sa, sb = shingles(a), shingles(b)
    assert got["r"] == pytest.approx(len(sa & sb) / len(sa | sb), abs=0.15)
    assert got["c"] == pytest.approx(len(sa & sb) / len(sa), abs=0.15)
    assert got["n"] == pytest.approx(len(sa), rel=0.3)
    assert len(set(got["m"]) & set(got["both"])) >= fingerprint.K - 8  # the joint text has a few shingles of its own
    parts = spark.createDataFrame([("g", a), ("g", b)], "g string, t string").withColumn("s", fingerprint.sketch("t"))
    assert fingerprint.merge_groups(parts, "g", "s").first()["sketch"] == got["m"]


# 6


def test_toxicity_learns_words_and_stems(spark, docs, none):
    r = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(500):
        words = prose(int(r.integers(20, 150)), 5000 + k).split()
        if k % 2:
            words[int(r.integers(len(words)))] = str(r.choice(["idiotic", "scumbag", "vequ" + r.choice(SYLLABLES) + r.choice(SYLLABLES)]))
        rows.append((k, " ".join(words)))
        labels.append((k, k % 2))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    net = toxicity.fit(frame, spark.createDataFrame([x for x in labels if x[0] < 400], "doc_id long, toxic int"))
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score(frame, net).collect()}
    held = range(400, 500)
    assert np.mean([got[k] == k % 2 for k in held]) >= 0.9
    odd = toxicity.score(docs, net).collect()
    assert len(odd) == docs.count() and all(0 <= x["score"] <= 1 for x in odd)
    assert all(x["score"] == 0 for x in odd if x["doc_id"] in (0, 1, 2))
    assert toxicity.score(none, net).count() == 0


def test_toxicity_learns_from_whole_texts(spark):
    """What makes a document toxic stands behind 7,000 characters of prose."""
    r = np.random.default_rng(8)
    plain = lambda k: prose(1600, 3000 + k)
    insult = lambda: " ".join(r.choice(["vrakzul", "grobnix", "zwuffel", "quarmog"], 24))
    rows = [(k, plain(k) + (f" {insult()}" if k % 2 else ""), k % 2) for k in range(240)]
    assert all(t.find("vrakzul") > 7000 for _, t, y in rows if y)
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.fit(frame.select("doc_id", "text"), frame.where("doc_id < 160").select("doc_id", "toxic"))
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score(frame, net).collect()}
    assert np.mean([got[k] == y for k, _, y in rows if k >= 160]) >= 0.9


def test_gradients_are_right():
    net = toxicity.Network(np.array([1], np.uint64), np.array([2], np.uint64))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, ids, length, d = r.normal(size=(6, toxicity.DIM)), r.integers(0, 6, (3, 5)), np.array([5, 3, 4]), np.array([1.0, -2, 0.5])
    _, kept = net.forward(x, ids, length, keep=True)
    g, dx = net.backward(x, ids, kept, d)
    for name in [*g, "x"]:
        v, want = (x, dx) if name == "x" else (net.p[name], g[name])
        at = tuple(int(r.integers(n)) for n in v.shape)
        v[at] += 1e-5
        up = (net.forward(x, ids, length)[0] * d).sum()
        v[at] -= 2e-5
        down = (net.forward(x, ids, length)[0] * d).sum()
        v[at] += 1e-5
        assert want[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


# 7


def test_language_model_is_naive_bayes(spark, docs, none):
    de = ["der die und das ist nicht ein zug", "die strasse und der weg", "das haus ist gross und schön"]
    en = ["the cat and the dog are here", "this is the house of the man", "where are the three ships"]
    train = spark.createDataFrame([(k, t, l) for l, ts in (("de", de), ("en", en)) for k, t in enumerate(ts)] + [(9, None, "fr"), (10, "x", None)], "doc_id long, text string, lang string")
    model = langid.Model.fit(train)
    assert model.langs == ["de", "en"]
    some = spark.createDataFrame(list(enumerate(["und die katze ist da", "the dog is there", None, "12 34 !", "", "und"])), "doc_id long, text string").coalesce(1)
    found = sorted(langid.predict(some, model).collect())
    names, score = [r["lang_pred"] for r in found], np.array([r["score"] for r in found])
    assert names == ["de", "en", "und", "und", "und", "de"] and (score[2:5] == 0).all() and (score[[0, 1]] > 0.5).all()
    one = langid.Model.fit(train, most=1)  # a matrix for each language
    assert len(list(one.parts())) == 2
    again = sorted(langid.predict(some, one).collect())
    assert [r["lang_pred"] for r in again] == names and [r["score"] for r in again] == pytest.approx(score)
    # the same by hand, n-gram by n-gram
    buckets, bounds, _ = langid.grams(pa.array([*de, *en, "the dog is there"]))
    counts = np.zeros((langid.BUCKETS, 2))
    for b in buckets:
        for row in range(6):
            for x in b[bounds[row] : bounds[row + 1]]:
                if x < langid.BUCKETS:
                    counts[x, row // 3] += 1
    logs = np.log(counts + langid.ALPHA) - np.log((counts + langid.ALPHA).sum(0))
    sums = np.log([0.5, 0.5]) + sum(logs[x] for b in buckets for x in b[bounds[6] : bounds[7]] if x < langid.BUCKETS)
    assert score[1] == pytest.approx(1 / np.exp(sums - sums.max()).sum())
    got = langid.predict(docs, model).collect()
    assert len(got) == docs.count()
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns
    assert langid.predict(none, model).count() == 0
    empty = langid.Model.fit(none)
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}


# 8


def plain_rule(url, rules):
    i = (url or "").find("://")
    rest = url[i + 3 :] if i >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p if "/" in rule else ""):
            fits.append((len(rule), len(h), rule, verdict))
    best = max(fits) if fits else (0, 0, None, urlfilter.DEFAULT)
    return host, path, best[2], best[3]


@pytest.mark.parametrize("many", [False, True])
def test_url_rules(spark, many):
    r = np.random.default_rng(4)
    hosts = ["com", "example.com", "a.example.com", "b.a.example.com", "notexample.com", "net", "example.net", "org", "EXAMPLE.org", "", "x..com"]
    paths = ["", "/", "/en/", "/en/7", "/en/77/x", "/de/8#top", "/de/", "/es/1?q=/en/", "?q", "/\U0010ffff"]
    urls = [None, "", "nourl", "://", "http://", *(f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(400))]
    rules = list(URL_RULES)
    if many:
        rules = list({f"{h.lower()}{p}": ("block" if r.random() < 0.5 else "allow") for h in hosts if h for p in ["", "/", "/en/", "/en/7", "/en/77", "/d"] if r.random() < 0.7}.items())
    pages = spark.createDataFrame([(k if k % 9 else None, u, "x") for k, u in enumerate(urls + urls[:50])], "page_id long, url string, host string")
    got = collections.Counter(tuple(x) for x in urlfilter.judge(pages, urlfilter.rule_table(spark, rules)).collect())
    want = collections.Counter((k if k % 9 else None, *plain_rule(u, rules)) for k, u in enumerate(urls + urls[:50]))
    assert got == want
    assert urlfilter.judge(pages.limit(0), urlfilter.rule_table(spark, rules)).count() == 0
    assert urlfilter.judge(pages, urlfilter.rule_table(spark, rules).limit(0)).where("rule IS NOT NULL").count() == 0


# 9


def plain_components(rows, num=90, den=100):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), (1, 0)), (i is None, i or 0))
    return collections.Counter((i, len(sets[k]), None if least[find(k)][0] else least[find(k)][1]) for k, (i, _) in enumerate(rows))


def as_counter(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_jaccard_components(docs, none):
    assert as_counter(jaccard.join(docs)) == plain_components(all_texts(docs))
    assert jaccard.join(none).count() == 0
    kept = jaccard.keep_first(docs)
    want = plain_components(all_texts(docs))
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for (i, n, c), k in want.items() for _ in range(k if n == 0 else 1) if n == 0 or i == c)
    assert jaccard.keep_first(none).count() == 0


def edited(words, r, share):
    words = list(words)
    for k in r.choice(len(words), max(1, int(len(words) * share)), replace=False):
        words[k] = "".join(r.choice(SYLLABLES, 3))
    return words


def test_jaccard_chains_and_large_groups(spark, monkeypatch):
    """Near copies at all distances, chains, short texts; regions so small a limit that they are split across tasks."""
    r = np.random.default_rng(9)
    rows = []
    for g in range(6):
        words = prose(int(r.integers(12, 220)), 900 + g).split()
        for _ in range(25):
            rows.append(" ".join(words))
            words = edited(words, r, float(r.choice([0.005, 0.02, 0.04])))
    rows = [(k, t) for k, t in enumerate(rows)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    assert as_counter(jaccard.join(frame)) == want
    monkeypatch.setattr(jaccard, "TASK_MEMBERS", 8)
    monkeypatch.setattr(jaccard, "DIRECT", 4)
    monkeypatch.setattr(jaccard, "BROADCAST_SHINGLES", -1)
    assert as_counter(jaccard.join(frame)) == want


def test_pipelines_near_duplicates(spark):
    """The stage takes five words and 0.8: copies with text appended and chains of edits, against all pairs."""
    r = np.random.default_rng(12)
    texts_ = ["", "one two three", "one two three"]
    for g in range(6):
        words = prose(int(r.integers(30, 260)), 700 + g).split()
        texts_ += [" ".join(words + prose(int(len(words) * share), 800 + 10 * g + k).split()) for k, share in enumerate((0, 0.14, 0.18, 0.22, 0.3))]
        for _ in range(8):
            words = edited(words, r, float(r.choice([0.01, 0.02, 0.03, 0.05])))
            texts_.append(" ".join(words))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in (t.split() for t in texts_)]
    near = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    root = list(range(len(sets)))
    for _ in sets:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    frame = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    got = [x["doc_id"] for x in corpus_pipeline.jaccard_join(spark, frame, "").collect()]
    assert sorted(got) == [k for k in range(len(sets)) if root[k] == k]


def test_linked_sets_meet_in_a_window():
    """Whatever shingles are called common, the first common shingle of two linked sets is in both windows."""
    r = np.random.default_rng(1)
    linked = 0
    for num, den in ((90, 100), (80, 100)):
        for _ in range(400):
            n = int(r.integers(1, 400))
            both = r.integers(0, 1 << 63, n).astype(np.uint64)
            lost = int(n * r.uniform(0, 0.2))
            x, y = np.unique(both[: n - lost // 2]), np.unique(both[lost - lost // 2 :])
            inter, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            if den * inter >= num * union and inter:
                linked += 1
                some = r.choice(both, int(r.integers(0, n + 1)), replace=False)
                common = jaccard.Common(np.unique(some), r.integers(3, 9, len(np.unique(some))))
                (ex, _), (ey, _) = common.window(x, num, den), common.window(y, num, den)
                met = set(ex.tolist()) & set(ey.tolist())
                assert met
                first = next(e for e in ex.tolist() if e in met)
                i, j = ex.tolist().index(first), ey.tolist().index(first)
                assert (i + j) * (den + num) <= (len(x) + len(y)) * (den - num)
    assert linked > 200


def family(r, groups, copies):
    sets = []
    for _ in range(groups):
        base = r.integers(0, 1 << 63, int(r.integers(20, 200))).astype(np.uint64)
        for _ in range(copies):
            keep = base[r.random(len(base)) > r.uniform(0, 0.12)]
            sets.append(np.unique(keep))
    return sets


def test_near_pairs_lose_none():
    """The recursive join within a region: no linked pair is lost, and pivots and windows do set members apart."""
    r = np.random.default_rng(6)
    sets = family(r, 14, 8)
    sketches = jaccard.Sketches(pa.array([jaccard.parity(s).tobytes() for s in sets]))
    n = np.array([len(s) for s in sets])
    tally = {}
    i, j = jaccard.near_pairs(sketches.table(np.arange(len(sets))), n, 90, 100, 32, tally)
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert sketches.distances(np.array([a]), np.array([b]))[0] <= n[a] + n[b] - 2 * both
        if 100 * both >= 90 * (n[a] + n[b] - both):
            assert (a, b) in got
    assert tally["regions"] >= 4 and tally["outside"] > 0


def test_regions_join_alike_at_every_size():
    """Forests of small and large regions connect what all pairs connect."""
    r = np.random.default_rng(16)
    sets = family(r, 12, 9)
    m = len(sets)
    t = pa.table({"region": np.sort(r.integers(0, 3, m)), "c": np.arange(m), "root": np.arange(m), "n": np.array([len(s) for s in sets], np.int32), "pos": np.zeros(m, np.int32), "sk": pa.array([jaccard.parity(s).tobytes() for s in sets])})
    found = {}
    for direct in (1 << 20, 4):
        for every in (True, False):
            got = jaccard.join_regions(t, 90, 100, every, direct)
            root = list(range(m))
            pairs = list(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
            for _ in range(m):
                for a, b in pairs:
                    root[a] = root[b] = min(root[a], root[b])
            found[direct, every] = sorted(pairs) if every else root
            if not every:
                assert len(pairs) < len(found[direct, True])
                for a, b in found[direct, True]:
                    assert root[a] == root[b]
    assert found[1 << 20, True] == found[4, True]


def test_ids_of_any_type(spark):
    """String ids, null ids, and the row of a component that stays."""
    a, b = prose(80, 41), prose(80, 42)
    near = " ".join([*a.split()[:79], "other"])
    frame = spark.createDataFrame([("k2", a), ("k10", near), (None, b), (None, b), (None, a), ("z", ""), (None, None)], "doc_id string, text string")
    got = sorted((r["doc_id"] or "", r["n_shingles"], r["component_id"] or "") for r in jaccard.join(frame).collect())
    assert got == [("", 0, ""), ("", 78, ""), ("", 78, ""), ("", 78, "k10"), ("k10", 78, "k10"), ("k2", 78, "k10"), ("z", 0, "z")]
    kept = sorted((r["doc_id"] or "", r["text"] or "") for r in jaccard.keep_first(frame).collect())
    assert kept == sorted([("k10", near), ("", b), ("z", ""), ("", "")])


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60) if k % 20 != 19] + [(100, 200), (200, 150)], "a long, b long")
    got = {r["c"]: r["root"] for r in jaccard.components(edges, Scratch(spark)).collect()}
    assert got == {k: k - k % 20 for k in range(60)} | {100: 100, 150: 100, 200: 100}


# 10


def plain_hits(t, items, window=8):
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), s or ""))
    w = words(t)
    hit, found = [0] * len(w), set()
    for item, text in items:
        p = words(text)
        m = min(window, len(p))
        for i in range(len(p) - m + 1) if m else ():
            for k in range(len(w) - m + 1):
                if w[k : k + m] == p[i : i + m]:
                    hit[k : k + m] = [1] * m
                    found.add(str(item) if item is not None else "")
    return len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2


@pytest.mark.parametrize("block_bytes", [1 << 20, 120])
def test_decontamination(spark, docs, none, block_bytes):
    long = prose(3000, 3).split()
    items = [(1, " ".join(long[100:130])), (2, " ".join(long[120:128]).upper()), (10, "ONE, two"), (11, "one"), (3, None), (4, ""), (5, prose(20, 77)), (None, " ".join(long[500:509])), (5, " ".join(long[2990:]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.search(docs, bench, block_bytes=block_bytes)
    got = collections.Counter(tuple(r) for r in decontam.digest(found).collect())
    want = collections.Counter((i, *plain_hits(t, items)) for i, t in all_texts(docs))
    assert got == want
    clean = decontam.keep_clean(docs, bench, least=1)
    assert clean.columns == docs.columns and clean.count() == sum(k for r, k in want.items() if r[3] == 0)
    assert decontam.search(none, bench).count() == 0
    assert decontam.search(docs, bench.limit(0)).where("n_hit > 0").count() == 0


# pipeline


def test_pipeline(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontaminate", "personal_data", "encode"]
    long = prose(3000, 3).split()
    spark.createDataFrame([(1, " ".join(long[100:130]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, step, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        before, step = step, spark.read.parquet(f"{tmp_path}/out{k}")
        assert k == 4 or step.columns == before.columns
    ids = sorted((r["doc_id"] for r in step.collect()), key=str)
    assert collections.Counter(ids) == collections.Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert 6 in ids and 7 not in ids and 11 not in ids and 0 not in ids


def test_stages_with_nothing_nulls_and_repeats(spark, docs, none, tmp_path):
    """Each stage on an empty table, and on one with null texts and ids, repeated rows and clashing names: columns stay, rows only go where they should."""
    spark.createDataFrame([("i1", "nothing that occurs in any of these texts at all here")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, none, str(tmp_path))
        assert empty.count() == 0, name
        got = stage(spark, docs, str(tmp_path))
        if name != "encode":
            assert empty.columns == got.columns == docs.columns
        rows = docs.count()
        if name == "language_id":
            letters = sum(1 for _, t in all_texts(docs) if any(c.isalpha() for c in t))
            assert got.where("text IS NULL").count() == 0 and 0 < got.count() <= letters
        elif name == "jaccard_join":
            assert got.where("text IS NULL").count() == 1 and got.count() < rows
        else:
            assert got.count() == rows, name


def test_stages_get_batches_of_bounded_bytes(spark, tmp_path):
    """However long the texts, a worker behind any stage gets a few MB at once, and every row; a lower limit of the caller's stays."""
    spark.createDataFrame([(1, "nothing that occurs in any of these texts at all here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    words = [prose(4000, 200 + k) for k in range(40)]
    long = spark.createDataFrame([(k, " ".join([w] * 15), "en", "s", 0) for k, w in enumerate(words)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(limit, "64m")
            assert stage(spark, long, str(tmp_path)).count() == 40, name
            got = long.mapInArrow(sizes, "rows long, bytes long").collect()
            assert sum(r["rows"] for r in got) == 40, name
            assert max(r["bytes"] for r in got) <= 6 << 20, name
            spark.conf.set(limit, "1m")
            stage(spark, long, str(tmp_path))
            assert spark.conf.get(limit) == "1m", name
    finally:
        spark.conf.set(limit, before)


@pytest.mark.parametrize("name", ["op8_url_filter", "op9_jaccard_join", "op10_decontaminate"])
def test_query_equals_its_sql(spark, name):
    import os

    import duckdb

    from locusframe.llm import queries

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, data).select(*want.columns)
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(want.fetchall())
