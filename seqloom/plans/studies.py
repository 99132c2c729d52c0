"""Registered queries of whole studies: sampling, models, comparisons and panels over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import motif as mo
from ..functions.hashing import as_number, hash_unit, keyed_hash, keyed_unit
from ..operators import audit, balancing, baselines, bootstrap, comparison, dataset, intervals, near_duplicates, networks, panels
from ..operators.lineage import cut
from ..sources import readers
from .catalog import HIT, MOTIF, _6, C, _edges, _reps, lsh_pairs, query
from .fixtures import CYCLE, LETTERS, WINDOWS, interval_sql, table, unit
from .fixtures import intervals as ivs
from .fixtures import windows

NETWORK = networks.Network.drawn(17)
LANGUAGES = ["de", "en", "es", "fr"]


@query()
def near_dup_blocks(s, d):
    """Candidate pairs verified by matching blocks, on either strand."""
    found = near_duplicates.verified_by_blocks(lsh_pairs(s, d), _reps(s, d), "doc_id", "seq")
    return found.select("a", "b", "strand", _6("identity").alias("identity"), _6("coverage").alias("coverage"))


@query(name="keyed_hash")
def _keyed_hash(s, d):
    docs = table(s, d, "documents").select("doc_id", "source")
    return docs.select("doc_id", as_number(keyed_hash(C("source"), C("doc_id"), seed=17)).alias("h"), keyed_unit(C("doc_id")).alias("u"))


_GENES = f"""{interval_sql('r', 'R')}, {interval_sql('a', 'A')}, exons AS (SELECT CAST(chrom AS VARCHAR) || ':' || CAST(st // 200 AS VARCHAR) AS gene, chrom, st, en FROM r), genes AS (SELECT gene, min(chrom) AS chrom, min(st) AS st, max(en) AS en FROM exons GROUP BY gene)"""


@query(f"""WITH {_GENES}, one AS (SELECT a.chrom, a.st, a.en, min(g.gene) AS gene FROM (SELECT DISTINCT chrom, st, en FROM a) a JOIN genes g ON a.chrom = g.chrom AND a.st < g.en AND a.en > g.st GROUP BY a.chrom, a.st, a.en HAVING count(*) = 1)
SELECT a.id, one.gene, CASE WHEN EXISTS (SELECT 1 FROM exons e WHERE e.gene = one.gene AND a.st < e.en AND a.en > e.st) THEN 'exonic' ELSE 'intronic' END AS context FROM a JOIN one ON one.chrom = a.chrom AND one.st = a.st AND one.en = a.en""")
def gene_context(s, d):
    """Windows over exactly one gene, exonic by that gene's own exons."""
    exons = ivs(s, d, "R").select(F.concat_ws(":", C("chrom").cast("string"), F.expr("st div 200").cast("string")).alias("gene"), "chrom", "st", "en")
    genes = exons.groupBy("gene").agg(F.min("chrom").alias("chrom"), F.min("st").alias("st"), F.max("en").alias("en"))
    return intervals.in_genes(ivs(s, d, "A"), genes, exons).select("id", "gene", "context")


# Comparisons


def _conditions(s, d):
    """Scores of two conditions and five seeds: the second leans towards the label a little more."""
    w = windows(s, d).select(C("gene").alias("component"), "label", "doc_id")
    cells = w.withColumn("condition", F.explode(F.array(F.lit("C0"), F.lit("C1")))).withColumn("seed", F.explode(F.array(*map(F.lit, range(1, 6)))))
    lean = F.when(C("condition") == "C1", 0.3).otherwise(0.2)
    return cells.withColumn("score", F.round(hash_unit(C("condition"), C("seed"), C("doc_id")) * (1 - lean) + lean * C("label"), 2))


@query()
def bootstrap_paired(s, d):
    """The difference in average precision between two conditions, for each seed."""
    made = bootstrap.interval(bootstrap.paired_ap(_conditions(s, d), "condition", "C0", "C1", "seed"), "delta", ["seed"])
    return made.select("seed", *[_6(c).alias(c) for c in ("mean", "lo", "hi")], "valid", "invalid")


def _preferences(s, d):
    edits = _conditions(s, d).withColumn("kind", F.explode(F.array(F.lit("target"), F.lit("outside"))))
    other = hash_unit(F.lit("edit"), C("kind"), C("condition"), C("seed"), C("doc_id"))
    gap = C("score") - F.when(C("kind") == "target", other * 0.9).otherwise(other)
    return edits.select("condition", "seed", "component", "kind", F.when(gap > 1e-6, 1.0).when(gap >= -1e-6, 0.5).otherwise(0.0).alias("value"))


@query()
def primary_comparison(s, d):
    """Both requirements and the guard, each with its interval."""
    made = comparison.primary(_conditions(s, d), _preferences(s, d))
    return made.select("requirement", *[_6(c).alias(c) for c in ("estimate", "lo", "hi")], "n", "agreeing", "passes")


@query()
def primary_claim(s, d):
    return comparison.claim(primary_comparison(s, d))


# Panels


@query(f"""WITH {WINDOWS}, e AS (SELECT quantile_cont(gc, 0.5) AS g, quantile_cont(tpm, 0.5) AS t FROM windows WHERE split = 'train'), b AS (SELECT windows.*, gc > g AS q, tpm > t AS t3 FROM windows, e),
c AS (SELECT context, q, t3, least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS n FROM b GROUP BY context, q, t3)
SELECT window_id, label FROM (SELECT b.*, c.n, row_number() OVER (PARTITION BY b.context, b.q, b.t3, label ORDER BY {unit("concat_ws(chr(31), '', window_id)")}, window_id) AS rn FROM b JOIN c ON c.context = b.context AND c.q = b.q AND c.t3 = b.t3) WHERE rn <= n""")
def matched_panel(s, d):
    """As many positives as backgrounds in each bin of context, base content and expression."""
    w = windows(s, d)
    half = w.filter("split = 'train'").agg(F.percentile("gc", F.lit(0.5)).alias("g"), F.percentile("tpm", F.lit(0.5)).alias("e"))
    binned = w.join(F.broadcast(half)).withColumn("q", C("gc") > C("g")).withColumn("t3", C("tpm") > C("e"))
    return panels.matched(binned, ["context", "q", "t3"])[0].select("window_id", "label")


_AUDIT = f"""a AS (SELECT *, {unit("concat_ws(chr(31), '', window_id)")} AS h FROM windows WHERE score >= 0.3), k AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY h, window_id) AS rn FROM a),
p AS (SELECT * FROM k WHERE rn <= 4 ORDER BY gene, h, window_id LIMIT 200)"""


@query(f"WITH {WINDOWS}, {_AUDIT} SELECT gene, window_id FROM p")
def audit_panel(s, d):
    """At most ceil(200 / 60) windows of a gene, and 200 in all."""
    return panels.audit(windows(s, d), 0.3, 200, 60, component="gene")[0].select("gene", "window_id")


@query(f"WITH {WINDOWS}, {_AUDIT} SELECT count(*) AS windows, count(DISTINCT gene) AS components, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS backgrounds, 4 AS cap, count(DISTINCT gene) < 60 OR count(*) < 120 AS exploratory FROM p")
def audit_panel_info(s, d):
    return panels.audit(windows(s, d), 0.3, 200, 60, component="gene")[1]


def _present(s, d):
    return windows(s, d).withColumn("present", C("gc") > 0.5)


@query(f"WITH {WINDOWS}, g AS (SELECT label, gc > 0.5 AS present, count(*) AS n FROM windows GROUP BY label, gc > 0.5) SELECT l.label, p.present, coalesce(n, 0) AS available, least(coalesce(n, 0), 16) AS selected, 16 - least(coalesce(n, 0), 16) AS short FROM (SELECT CAST(unnest([0, 1]) AS BIGINT) AS label) l CROSS JOIN (SELECT unnest([true, false]) AS present) p LEFT JOIN g ON g.label = l.label AND g.present = p.present")
def ism_panel_shortfall(s, d):
    """Windows with and without the motif, of either label: how many there are, are taken, and lack."""
    wanted = s.createDataFrame([(y, p) for y in (0, 1) for p in (True, False)], "label long, present boolean")
    return panels.by_stratum(_present(s, d), ["label", "present"], 16, component="gene", wanted=wanted)[1]


# Models


def _study(s, d):
    return windows(s, d).withColumn("log1p_tpm", C("tpm"))


@query(name="baselines")
def _baselines(s, d):
    """Each feature set with the grid's best model: how it ranks and how well it is calibrated on each split."""
    made = baselines.evaluated(_study(s, d).select("seq", "context", "log1p_tpm", "label", "split"), contexts=LANGUAGES, motif=MOTIF, threshold=HIT)
    return made.select("baseline", "split", "c", "n", *[_6(c).alias(c) for c in ("ap", "auroc", "log_loss", "brier")])


def _balanced(s, d):
    # Of each training window what the weights need, made once: sequences are not read again.
    counts = [(F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).alias(f"n_{b}") for b in "ACGU"]
    train = cut(_study(s, d).filter("split = 'train'").select("doc_id", "label", "split", "gc", "tpm", "log1p_tpm", "context", *counts))
    # One row: the edges of the bins.
    e = _edges(train).first()
    return balancing.weighted(train.drop("split", "tpm"), [e[f"gc_{i}"] for i in range(4)], [e[f"tpm_{i}"] for i in range(2)], LANGUAGES[:3], residual=("n_A", "n_C", "n_G", "n_U"))


@query()
def condition_weights(s, d):
    """Weights of both conditions, after merges and drops of strata."""
    return _balanced(s, d)[0].select("doc_id", "stratum", "kept", _6("w0").alias("w0"), _6("w1").alias("w1"))


@query()
def stratum_fates(s, d):
    return _balanced(s, d)[1]


@query()
def cnn_logits(s, d):
    """The network's logits of the labelled windows."""
    return networks.predicted(windows(s, d), "doc_id", "seq", NETWORK).select("doc_id", _6("logit").alias("logit"), _6("probability").alias("probability"))


@query()
def cnn_effects(s, d):
    """The network's effects of all substitutions in the windows of the small panel, exact and to first order."""
    panel, _ = panels.by_stratum(_present(s, d), ["label", "present"], 16, component="gene")
    made = networks.substitutions(panel.select("doc_id", "seq"), "doc_id", "seq", NETWORK)
    return made.select("doc_id", "pos", "base", _6("exact").alias("exact"), _6("first_order").alias("first_order"))


# The audit of the network


def _scored(s, d):
    """The validation windows with the best score of the queries' motif."""
    w = windows(s, d).filter("split = 'validation'").select("window_id", "doc_id", C("gene").alias("component"), "label", "seq")
    best = mo.with_best(w, "doc_id", "seq", MOTIF, HIT).select(C("doc_id").alias("_d"), C("best").alias("score"))
    return w.join(best, C("doc_id") == C("_d")).drop("doc_id", "_d")


@query()
def audit_edits(s, d):
    """Every edit of the panel's windows, with its place, the scores of the hit before and after, and what it changes."""
    made = audit.edits_of(audit.panel_edits(_scored(s, d), MOTIF, HIT)[1])
    return made.select("window_id", "kind", "edit", "sequence", "start", "end", _6("score").alias("score"), _6("edited_score").alias("edited_score"), "new_hits", "pair_change")


@query()
def audit_controls(s, d):
    """How many windows have a hit, edits of either kind, or too few; and whether all edits keep their bases."""
    return audit.controls_summary(audit.panel_edits(_scored(s, d), MOTIF, HIT)[1]).withColumn("mean_pair_change", _6("mean_pair_change"))


@query()
def audit_preferences(s, d):
    """How often the network prefers the natural sequence, by component and kind of edit."""
    made = audit.preferences(audit.edits_of(audit.panel_edits(_scored(s, d), MOTIF, HIT)[1]), NETWORK)
    return audit.by_component(made).select("kind", "component", "edits", _6("value").alias("value"))


@query()
def audit_decision(s, d):
    """Whether first-order effects agree with exact ones well enough on the panel of substitutions."""
    return audit.decided(audit.substitution_checks(_scored(s, d), HIT, NETWORK)[1]).withColumns({c: _6(c) for c in ("spearman", "sign_agreement")})


# The dataset and its split

GENE, EXON = 1500, 300
BUILD = dataset.Rules(buffer=50, assembly="documents", least_tpm=1.0)


def _contigs(s, d):
    """Each document's letters are a contig. Spelled once, by all tasks, as sizes, genes and each look at the letters need them anew."""
    docs = table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", "text").repartition(int(s.conf.get("spark.sql.shuffle.partitions")))
    letters = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, CYCLE.replace("U", "T"))
    return cut(docs.select(F.concat(F.lit("d"), C("doc_id").cast("string")).alias("contig"), letters.alias("sequence")))


def _peaks(s, d):
    """Returned items are peaks on the contig that has their part's number; some name no contig, or lie outside of it."""
    rows = ivs(s, d, "R").filter("st < en")
    return rows.select(F.concat(F.lit("d"), C("chrom").cast("string")).alias("chrom"), C("st").alias("start"), C("en").alias("end"), F.when(C("id") % 2 == 0, "+").otherwise("-").alias("strand"), (C("id") % 97).cast("double").alias("signal"))


def _annotation(contigs):
    """genes, exons, expression: a gene for each 1,500 letters, of which 1,450 are its span; exons of 120 in each 300."""
    spans = contigs.select(C("contig").alias("chrom"), F.length("sequence").alias("size"))
    at = F.posexplode(F.sequence(F.lit(0), F.greatest(C("size") - 1, F.lit(0)), F.lit(GENE))).alias("i", "start")
    # Small beside the letters; genes, exons, expression and the looks at each of them start from it.
    spans = cut(spans)
    genes = spans.select("chrom", "size", at).withColumn("gene_id", F.concat_ws(":", "chrom", C("i").cast("string"))).withColumn("end", F.least(C("start") + GENE - 50, "size")).filter("end > start")
    exons = genes.select("gene_id", "chrom", "end", F.explode(F.sequence("start", C("end") - 1, F.lit(EXON))).alias("start")).select("gene_id", "chrom", "start", F.least(C("start") + 120, "end").alias("end"))
    return genes.select("gene_id", C("gene_id").alias("gene_name"), "chrom", "start", "end"), exons, genes.select("gene_id", (hash_unit(C("gene_id")) * 10).alias("tpm"))


def _chunks(contigs):
    return readers.fasta_chunks(contigs, BUILD.chunk)


@query(f"""WITH RECURSIVE {interval_sql('iv', 'R')}, p AS (SELECT 'd' || CAST(iv.chrom AS VARCHAR) AS chrom, st AS ps, en AS pe, CASE WHEN id % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(id % 97 AS DOUBLE) AS signal, (st + en) // 2 - 100 AS st, (st + en) // 2 + 101 AS en FROM iv WHERE st < en),
sizes AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS chrom, length(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS size FROM documents WHERE text IS NOT NULL),
o AS (SELECT p.*, row_number() OVER (PARTITION BY p.chrom ORDER BY p.st, ps, pe, strand, signal) AS rn FROM p JOIN sizes ON p.chrom = sizes.chrom WHERE st >= 0 AND en <= size),
k AS (SELECT chrom, rn, en AS last, true AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.chrom, o.rn, CASE WHEN o.st >= k.last THEN o.en ELSE k.last END, o.st >= k.last FROM k JOIN o ON o.chrom = k.chrom AND o.rn = k.rn + 1)
SELECT o.chrom, o.st, o.en, strand, ps AS peak_start, pe AS peak_end, signal FROM o JOIN k ON o.chrom = k.chrom AND o.rn = k.rn WHERE kept""")
def positive_windows(s, d):
    """Windows about peaks, within their contig, that do not overlap one that starts earlier and stays."""
    return dataset.positives(_peaks(s, d), _chunks(_contigs(s, d)), BUILD)[0].select("chrom", "st", "en", "strand", "peak_start", "peak_end", "signal")


@query(f"""WITH {interval_sql('iv', 'R')}, p AS (SELECT 'd' || CAST(iv.chrom AS VARCHAR) AS chrom, (st + en) // 2 - 100 AS st, (st + en) // 2 + 101 AS en FROM iv WHERE st < en),
sizes AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS chrom, length(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS size FROM documents WHERE text IS NOT NULL AND regexp_matches(lower(text), '[a-z]'))
SELECT CASE WHEN size IS NULL THEN 'chromosome_not_in_genome' ELSE 'window_out_of_bounds' END AS reason, p.chrom, st AS "start", en AS "end" FROM p LEFT JOIN sizes ON p.chrom = sizes.chrom WHERE size IS NULL OR st < 0 OR en > size""")
def positives_out_of_place(s, d):
    """Peaks whose contig is unknown or too short for their window."""
    return dataset.positives(_peaks(s, d), _chunks(_contigs(s, d)), BUILD)[1].filter("reason IN ('chromosome_not_in_genome', 'window_out_of_bounds')")


def _built(s, d):
    contigs = _contigs(s, d)
    return dataset.build(_peaks(s, d), *_annotation(contigs), _chunks(contigs), BUILD)


@query()
def dataset_rows(s, d):
    return _built(s, d).rows.select("window_id", "chrom", "start", "end", "strand", "label", "gene_id", "context", "sequence", _6("gc").alias("gc"), _6("tpm").alias("tpm"))


@query()
def dataset_report(s, d):
    return _built(s, d).report


@query()
def dataset_split(s, d):
    """The dataset's rows with component and split, after the checks of the split."""
    made = dataset.checked_split(_built(s, d).rows, most_lost=1.0)
    return made.rows.select("window_id", "gene_id", "label", "component", "split")
