"""Each operator against a brute-force version, and on odd tables."""

import collections
import functools
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import chat, decontaminate, html, mixing, near, quality, scoring, substring, tokens, topk
from seqloom.llm._shared import Powers, Shelf
from seqloom.llm.components import components

random.seed(11)
LEXICON = ["".join(random.choices("abcdefgh", k=random.randint(2, 7))) for _ in range(400)]


def prose(n, rng):
    return " ".join(rng.choices(LEXICON, k=n))


def corpus():
    rng = random.Random(7)
    passage = prose(60, rng)
    base = prose(200, rng)
    words = base.split()
    close = " ".join(words[:100] + ["changed"] + words[101:])
    rows = [(i, prose(rng.randint(3, 150), rng), f"s{i % 3}") for i in range(20)]
    rows += [(20, base, "s0"), (21, base, "s0"), (22, close, None), (23, prose(30, rng) + " " + passage + " " + prose(30, rng), "s1"), (24, passage + "\n" + prose(20, rng), "s1")]
    rows += [(25, None, "s2"), (26, "", None), (27, "one", "s0"), (28, "one", "s0"), (28, "one", "s0"), (None, prose(50, rng), "s0"), (30, "rep " * 90, "s2"), (31, prose(9000, rng), "s1")]
    return rows


def cut(texts, width=35):
    seen = collections.Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    for w in texts:
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        yield len(w), len(gone), hashlib.sha256(kept).hexdigest()


def split(t):
    return (t or "").encode().split()


def test_substring(docs):
    rows = corpus()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs(rows, True)).collect())
    assert got == sorted((r[0] if r[0] is not None else -1, *x) for r, x in zip(rows, cut([split(r[1]) for r in rows])))
    assert substring.rows_with_repeats_removed(docs(rows, True)).columns == docs(rows, True).columns
    assert substring.remove_repeats(docs([])).count() == 0


@pytest.mark.parametrize("period", substring.COVERS)
def test_covers(period):
    d = substring.COVERS[period]
    assert {(a - b) % period for a in d for b in d} == set(range(period))


def bags(t):
    w = split(t)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def similar(a, b):
    z = set(a) | set(b)
    return sum(1 / sum(max(a[q] / a[d], b[q] / b[d]) for q in z) for d in set(a) & set(b)) >= 0.8


def test_near_classes(docs):
    rows = [r for r in corpus() if r[0] != 31]
    sets = [bags(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and similar(sets[i], sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    least = {k: min((rows[i][0] for i in range(len(rows)) if root[i] == k and rows[i][0] is not None), default=None) for k in set(root)}
    want = sorted(((rows[i][0], least[root[i]]) for i in range(len(rows))), key=str)
    assert sorted(((r.doc_id, r.class_id) for r in near.classes(docs(rows, True)).collect()), key=str) == want
    assert near.one_of_each(docs(rows)).count() == len(set(root))
    assert near.classes(docs([])).count() == 0


def test_near_hot_group(docs):
    rng = random.Random(3)
    base = prose(300, rng).split()
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(w), "s"))
    assert {r.class_id for r in near.classes(docs(rows)).collect()} == {0}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a, w = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64)), rng.integers(1, 5, 300)
    b = np.sort(np.concatenate([a[30:], rng.integers(0, 2**63, 30).astype(np.uint64)]))
    sig = near.signatures([(a, w), (b, w)], 4096)
    assert abs((sig[0] == sig[1]).mean() - near.probability_jaccard((a, w), (b, w))) < 0.03


def test_components_both_ways(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(50, 51), (51, 52)], "a long, b long")
    shelf = Shelf(spark, "test")
    a, b = ({r.node: r.label for r in components(edges, shelf, n, few).collect()} for n, few in (("x", 10), ("y", 1000)))
    assert a == b and a[40] == 0 and a[52] == 50


def test_decontamination(spark, docs):
    rng = random.Random(5)
    items = [prose(n, rng) for n in (15, 40, 25, 3)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    w = items[1].split()
    rows = [(0, prose(50, rng) + " " + items[0].upper() + "!!! " + prose(50, rng), "s"), (1, " ".join(w[:1] + ["other"] + w[2:]), "s"), (2, prose(200, rng), "s"), (3, items[3], "s"), (4, None, "s"), (5, items[2], "s"), (5, items[2], "s"), (6, " ".join(w[:20]), "s")]
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(rows, True), bench).collect())
    assert got == [(0, 0), (1, 1), (5, 2), (5, 2)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs(rows), bench).collect()) == [2, 3, 4, 6]
    assert decontaminate.contaminated(docs(rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs([]), bench).count() == 0


def shingles_of(words):
    return collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_decontamination_edited_ends(spark, docs):
    rng = random.Random(6)
    items, rows = [prose(n, rng).split() for n in (50, 60, 100, 200)], []
    items.append(items[0][:30] + ["same"] * 30)
    for item in items:
        most = len(item) // 9
        for cut in [most, most - 1, most - 2] * 2:
            front, back = prose(9, rng).split(), prose(80, rng).split()
            rows += [front + item[: len(item) - cut] + back, front + back + item[cut:] + front, front + item[: len(item) - cut], front + item[cut // 2 : len(item) - cut // 2] + back]
        half = len(item) // 2
        rows += [back + item[half:] + item[:half] + front, item[:-cut], item[: len(item) - cut] + ["end"] * cut]
    def similarity(words, item, start):
        a, b = shingles_of(item), shingles_of(words[start : start + len(item)])
        common = (a & b).total()
        return round(common / (a.total() + b.total() - common), 9)

    values = {(i, j): max(similarity(words, item, s) for s in range(max(1, len(words) - len(item) + 1))) for i, words in enumerate(rows) for j, item in enumerate(items) if set(words) & set(item)}
    want = {k: v for k, v in values.items() if v >= 0.8}
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    made = decontaminate.contaminated(docs([(i, " ".join(w), "s") for i, w in enumerate(rows)]), bench).collect()
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in made}
    assert sum(v < 0.9 for v in want.values()) > 50
    assert (len(made), got) == (len(want), want)
    assert all(similarity(rows[r.doc_id], items[r.item_id], r.start) == got[r.doc_id, r.item_id] for r in made)


def test_html():
    page = b"<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class='ad'>Buy, now.</div><article><h1>Head &amp; line</h1><p>A <b>bo</b>ld  text.<br>Next<p>Two</p><script>var x='</p>';</script></article><footer>c</footer>"
    assert html.main_text(page) == "Head & line A bold text. Next Two"
    assert [html.main_text(x) for x in (None, b"", b"<p></p>", b"<!-- x")] == [""] * 4
    plain = b"<body><div><p>Long text, with marks. More, here.</p><p>And so on, yes.</p></div><div class='comments'><p>I think, long text, not so.</p></div></body>"
    assert html.main_text(plain) == "Long text, with marks. More, here. And so on, yes."


def test_html_ratios_decide_where_the_article_is_marked():
    links = b"".join(b"<li><a href='/%d'>Go %d</a></li>" % (i, i) for i in range(8))
    texts = b"".join(b"<p>Long text, with many marks, and more of them. It goes on, here, for a while.</p>" for _ in range(3))
    page = b"<body><main><h1>Head</h1>" + texts + b"<hr><div class='x'><span></span></div><ul>" + links + b"</ul></main></body>"
    assert html.main_text(page) == "Head " + " ".join(["Long text, with many marks, and more of them. It goes on, here, for a while."] * 3)


def test_topk(spark):
    rng = np.random.default_rng(2)
    made = rng.normal(0, 0.3, (300, 8))
    made[100:180] = made[50]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made)] + [(400, None), (450, [1.0, None]), (500, [float("nan")]), (50, [float(x) for x in made[50]])]
    good = [(i, np.floor(256 * np.array(v, np.float64))) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    # The table holds doubles here, so no rounding to single precision takes place.
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for n, (i, q) in enumerate(good):
        if i % 50 == 0:
            near_ = sorted((-int(q @ v), j, m) for m, (j, v) in enumerate(good) if m != n)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j, _) in enumerate(near_)]
    assert sorted(map(tuple, topk.search(df).collect())) == sorted(want)
    assert topk.search(df.limit(0)).count() == 0


def context_tree(texts, asked):
    """log10 of the asked texts' probabilities after learning ``texts``: weights by recursion over a dict of nodes."""
    counts = collections.defaultdict(lambda: [0, 0])

    def decisions(data):
        for i, byte in enumerate(data):
            context = (b"\0" * 5 + data)[i : i + 5][::-1]
            for k in range(8):
                yield context, (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1

    for data in texts:
        for context, prefix, bit in decisions(data):
            for d in range(6):
                counts[context[:d], prefix][bit] += 1
    below = collections.defaultdict(list)
    for context, prefix in counts:
        if context:
            below[context[:-1], prefix].append((context, prefix))

    def kt(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(zeros + ones + 1)

    @functools.cache
    def weighted(node):
        own = kt(*counts[node])
        return own if len(node[0]) == 5 else np.logaddexp(own, sum(map(weighted, below[node]))) - math.log(2)

    @functools.cache
    def probability(context, prefix):
        done, left, last = 0.0, 1.0, 0.5
        for d in range(6):
            if (node := (context[:d], prefix)) in counts:
                zeros, ones = counts[node]
                last = (ones + 0.5) / (zeros + ones + 1)
                stop = math.exp(kt(zeros, ones) - math.log(2) - weighted(node)) if d < 5 else 1.0
                done, left = done + left * stop * last, left * (1 - stop)
            elif d == 0:
                done, left = 0.25, 0.5  # nothing was learnt of this decision
        return done + left * last

    for data in asked:
        yield sum(math.log10(p if bit else 1 - p) for c, prefix, bit in decisions(data) for p in [probability(c, prefix)])


def test_scoring_matches_one_process_and_ways_to_deal_do_not_matter(docs):
    rows = corpus()
    made = [sorted(map(tuple, scoring.scores(docs(rows, i == 0).repartition(i + 1), *x).collect()), key=str) for i, x in enumerate([(None, 1 << 20), (3, 500), (700, 20_000)])]
    assert made[0] == made[1] == made[2]
    a = [r for r in scoring.scores(docs(rows)).collect()]
    assert sorted(map(tuple, a), key=str) == made[0]
    counts = collections.Counter()
    for i, t, _ in rows:
        if not scoring.held_out(i):
            counts.update([*split((t or "").lower()), "end"])
    total, distinct = sum(counts.values()), len(counts)
    text = {i: b" ".join(split((t or "").lower())) + b"\n" for i, t, _ in rows}
    scores = context_tree([b" ".join(split((t or "").lower())) + b"\n" for i, t, _ in rows if not scoring.held_out(i)], [text[x.doc_id] for x in a])
    for x, score in zip(a, scores):
        words = [*text[x.doc_id].split(), "end"]
        base = sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        assert x.n_tokens == len(words) and x.train_tokens == total and x.n_known == sum(counts[w] > 0 for w in words) and x.n_bytes == len(text[x.doc_id])
        assert abs(x.base_score - base) < 1e-6 and abs(x.score - score) < 1e-6 * max(1, abs(score))
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 7 == 2)
    assert scoring.scores(docs([])).count() == 0


def test_scoring_cuts_long_texts_alike():
    rng = random.Random(9)
    texts = [prose(n, rng).encode() for n in (3, 4000, 1, 900)]
    whole = [scoring.sequences(np.frombuffer(b"\0" * 5 + t, np.uint8).astype(np.uint64)) for t in texts]
    old, scoring.CHUNK = scoring.CHUNK, 1000
    try:
        made = list(scoring._chunks(texts))
    finally:
        scoring.CHUNK = old
    assert len(made) > 10 and np.array_equal(np.concatenate([k for _, k in made]), np.concatenate(whole))
    assert np.array_equal(np.concatenate([o for o, _ in made]), np.repeat(np.arange(4), [len(t) for t in texts]))


def test_kt_by_its_definition():
    a, b = np.array([0, 3, 5000]), np.array([0, 2, 1])
    got = scoring.kt(a, b)
    for x, y, z in zip(a, b, got):
        p, n0, n1 = 0.0, 0, 0
        for bit in [0] * x + [1] * y:
            p += np.log(((n1 if bit else n0) + 0.5) / (n0 + n1 + 1))
            n0, n1 = n0 + (1 - bit), n1 + bit
        assert abs(p - z) < 1e-7 * max(1, abs(p))


def test_quality_on_held_out_rows(spark):
    where = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    got = quality.scored(d, quality.learn(d, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_quality_odd_tables(spark, docs):
    rows, none = corpus(), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    forest = quality.learn(docs(rows), none)
    got = quality.scored(docs(rows, True), forest).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(docs([]), quality.learn(docs([]), none.limit(0))).count() == 0
    assert quality.accepted(docs(rows, True), forest, 0.0).count() == len(rows)


def test_quality_counts_repeated_rows(spark, docs):
    rng = random.Random(8)
    learnt = next(i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(i, prose(5 + i, rng), "s") for i in range(60)] + [(learnt, prose(200 + i, rng), "s") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)], "doc_id long, quality int")
    seen = []
    old, quality.fit = quality.fit, lambda x, y, *n: seen.append((x, y, *n)) or old(x, y, *n)
    try:
        quality.learn(docs(rows), labels, sample=60)
        quality.learn(docs(rows[:60] * 40), labels, sample=60)
    finally:
        quality.fit = old
    # The longest texts are in the sample too, and repeats are counted instead of taking its places.
    assert seen[0][0][:, 0].max() > np.log1p(200)
    x, y, n = seen[1]
    assert len(x) == len(np.unique(x, axis=0)) > 30 and set(n) == {40}
    a, b = old(x, y, n), old(np.repeat(x, 40, axis=0), np.repeat(y, 40))
    assert np.allclose(a.scores(x), b.scores(x))


def test_token_counts_match_the_library(docs):
    from tokenizers import Tokenizer, models

    vocabulary = tokens.load()
    least = min(s for _, s in vocabulary.pieces)
    model = Tokenizer(models.Unigram([("<unk>", least), *vocabulary.pieces, *((f"<0x{i:02X}>", least) for i in range(256))], 0, True))
    words = [*LEXICON[:100], "naïve", "日本語", "x🤖🤖y", "a" * 50, "Hello,"]
    for w in words:
        assert vocabulary.count("▁" + w)[0] == len(model.encode("▁" + w).ids), w
    small = tokens.Vocabulary([("▁a", -1.0), ("b", -1.0), ("bb", -2.0), ("▁", -3.0), ("a", -3.0)], False)
    other = Tokenizer(models.Unigram([("<unk>", -3.0), *small.pieces], 0, False))
    for w in ("▁abb", "▁bbb", "▁azzb", "zz"):
        assert small.count(w)[0] == len(other.encode(w).ids), w
    got = tokens.token_counts(docs(corpus(), True), vocabulary).collect()
    assert len(got) == len(corpus()) and all((r.n_tokens == 0) == (r.n_words == 0) for r in got)


def test_chat_round_trip():
    pieces = ["<", "s>", "/s>", "[", "INST]", "/INST]", "\\", "x", "<s>", "\n", '"', "[/TURN]"]
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 8)))
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)
        turns = [(rng.choice(["user", "assistant", "system", 'tool"', text]), text) for _ in range(3)]
        made = chat.format_turns(turns)
        assert chat.read_back(made.text) == turns
        assert "".join(chat.unescape(made.text[a:b]) for a, b in made.mask) == "".join(t for r, t in turns if r == "assistant")


def test_chat_parts():
    made = chat.format_turns([("user", [{"type": "text", "text": "see <s>"}, {"type": "image", "ref": "a.png", "width": 56, "height": 28}, {"type": "audio", "ref": "b", "seconds": 2}, {"type": "document", "ref": "c", "pages": 2}]), ("assistant", "ok")])
    assert made.text == "<s>[INST]see <\\s>[IMAGE][AUDIO][DOCUMENT][/INST]ok</s>"
    assert [(a.kind, a.reference, a.tokens, a.turn) for a in made.attachments] == [("image", "a.png", 2, 0), ("audio", "b", 50, 0), ("document", "c", 512, 0)]


def test_chat_tables(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[None].turns_sha256 == hashlib.sha256(b"\nx\n").hexdigest()
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_tables_of_parts(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    see = [("text", "see <s>", None, None, None, None, None), ("image", None, "a.png", 56, 28, None, None), None, ("audio", None, "b", None, None, 2.0, None), ("document", None, "c", None, None, None, 2)]
    rows = [(1, 0, "user", see), (1, 1, "assistant", [(None, "ok", None, None, None, None, None)]), (2, 0, "user", None)]
    got = {r.conv_id: r for r in chat.formatted(spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{part}>").withColumn("text", F.lit("x"))).collect()}
    assert got[1].formatted == "<s>[INST]see <\\s>[IMAGE][AUDIO][DOCUMENT][/INST]ok</s>" and got[2].formatted == "<s>[INST][/INST]"
    assert [tuple(a) for a in got[1].attachments] == [("image", "a.png", 2, 0), ("audio", "b", 50, 0), ("document", "c", 512, 0)] and got[2].attachments == []
    plain = chat.formatted(spark.createDataFrame([(1, 0, "user", "a<s>")], "conv_id long, turn long, role string, text string")).first()
    assert plain.formatted == "<s>[INST]a<\\s>[/INST]" and plain.attachments == []


def test_mixing(docs):
    rows = corpus()
    got = mixing.mix(docs(rows, True)).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(split(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, capped = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert abs(r.target - (3 * sizes[r.source] if r.source in capped else level * weight[r.source])) < 1e-6 * total
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source]
    assert len(got) == len(rows)
    again = sorted(map(str, mixing.mix(docs(rows)).collect()))
    assert again == sorted(map(str, got))
    kept = mixing.mixed(docs(rows, True))
    assert kept.columns == [*docs(rows, True).columns, "copies", "taken"] and sum(r.taken for r in kept.collect()) == sum(taken.values())
    assert mixing.mix(docs([])).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    where = "/root/testdata/sf0.001"
    start = spark.read.parquet(f"{where}/documents.parquet")
    frame = start
    for name, stage in corpus_pipeline.STAGES:
        before = frame
        frame = Shelf(spark, "test").put(stage(spark, frame, where), "stage")
        if name != "source mixing":
            assert frame.columns == start.columns
        assert frame.count() <= before.count()
    bench = [r.text for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
    assert not any(b in (r.text or "") for r in frame.collect() for b in bench)
    assert frame.count() == corpus_pipeline.run(spark, where).count()
