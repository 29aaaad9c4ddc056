"""Studies to sentences, atoms and criteria, with the counters that report the yield.

Segmentation and extraction are narrow projections. Removing duplicates is an aggregation by key. What an extractor finds
depends on the sentence alone, so alike() has each sentence of a section once and it is looked at once however often it occurs.
The capped corpus keeps, in order of study and position, a sentence whose key no earlier kept one
has, up to a number per study: each decision depends on earlier ones of other studies. It is found
in rounds (see `first_capped`), each two aggregations, so no task ever holds all sentences.

Defined cases: a null id or text gives no rows; an id that occurs twice gives the rows of each; an
empty table gives none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import logic, text
from ..plans.skew import frequent_join
from ..plans.stages import written

PER_STUDY = 4
#: Keys that are sent by broadcast in a round of first_capped.
FREQUENT = 1000
REASONS = ["length_out_of_range", "boilerplate_phrase", "no_pattern_matched", "no_faithful_mapping"]


def sentences(studies: DataFrame, study: str = "study_id", body: str = "text") -> DataFrame:
    """study_id, pos, section, sentence and skipped (why a sentence isn't looked at, or NULL)."""
    rows = studies.where(F.col(study).isNotNull()).select(F.col(study).alias("study_id"), F.explode(text.sentences(F.col(body))).alias("s"))
    return rows.select("study_id", "s.*").withColumn("skipped", text.skipped(F.col("sentence")))


def alike(rows: DataFrame) -> DataFrame:
    """The rows of sentences() with those of one section and sentence as one: the least (study_id, pos), and n of them.

    Write what is extracted from it before filtering by it: a filter would move below this aggregation, to every row."""
    one = rows.groupBy("section", "sentence", "skipped").agg(F.min(F.struct("study_id", "pos")).alias("p"), F.count(F.lit(1)).alias("n"))
    return one.select("p.study_id", "p.pos", "section", "sentence", "skipped", "n")


def _weight(rows: DataFrame) -> Column:
    """How many sentences a row stands for."""
    return F.col("n") if "n" in rows.columns else F.lit(1).cast("long")


def atoms(studies: DataFrame, **names: str) -> DataFrame:
    """sentences() with `hit` (tree, pattern) of those that map to an atom; the others have no_pattern_matched in skipped."""
    return with_atoms(sentences(studies, **names))


def with_atoms(rows: DataFrame) -> DataFrame:
    """atoms() of the rows of sentences() or alike()."""
    rows = rows.withColumn("hit", F.when(F.col("skipped").isNull(), text.sentence_atom(F.col("sentence"))))
    return rows.withColumn("skipped", F.when(F.col("skipped").isNull() & F.col("hit").isNull(), "no_pattern_matched").otherwise(F.col("skipped")))


def yield_counts(found: DataFrame) -> DataFrame:
    """kind (total, skipped, pattern), name and n over the rows of atoms() or with_atoms()."""
    cells = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("considered").alias("name")),
        F.struct(F.when(F.col("skipped").isNull(), "pattern").otherwise("skipped").alias("kind"), F.coalesce("skipped", "hit.pattern").alias("name")),
    )
    return found.select(F.explode(cells).alias("c"), _weight(found).alias("w")).groupBy("c.kind", "c.name").agg(F.sum("w").alias("n"))


def distinct_atoms(found: DataFrame, per_study: int | None = None) -> DataFrame:
    """One row of each atom: that of the least (study_id, pos), with the number of rows that have it.

    per_study: so many of each study at most. A study isn't read on once it is full, so an atom further down may come
    from a later one (first_capped), and found must be of single sentences."""
    keyed = found.where("hit IS NOT NULL").withColumn("key", F.sha2(logic.key(F.col("hit.tree")), 256))
    rest = F.struct("study_id", "pos", "section", "sentence", "hit")
    if per_study is None:
        return keyed.groupBy("key").agg(F.min_by(rest, F.struct("study_id", "pos")).alias("r"), F.sum(_weight(found)).alias("n")).select("key", "r.*", "n")
    if "n" in found.columns:
        raise ValueError("a number for each study needs single sentences")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return first_capped(keyed, per_study).select("key", "study_id", "pos", "section", "sentence", "hit").join(counts, "key")


def mapped(studies: DataFrame, **names: str) -> DataFrame:
    """sentences() with `form` (tree, rule, negated) of those that map faithfully; the others have no_faithful_mapping in skipped."""
    return with_forms(sentences(studies, **names))


def with_forms(rows: DataFrame) -> DataFrame:
    """mapped() of the rows of sentences() or alike()."""
    rows = rows.withColumn("form", F.when(F.col("skipped").isNull(), text.sentence_expression(F.col("sentence"))))
    return rows.withColumn("skipped", F.when(F.col("skipped").isNull() & F.col("form").isNull(), "no_faithful_mapping").otherwise(F.col("skipped")))


def sentences_with_forms(studies: DataFrame, extra: dict[str, Column] | None = None, **names: str) -> tuple[DataFrame, DataFrame]:
    """study_id, pos, section and sentence of the sentences that are looked at, and what each different one maps to: section, sentence,
    form and the columns of `extra` (of form). Each different sentence is mapped once; the most frequent meet their rows by broadcast."""
    rows = written(sentences(studies, **names).where("skipped IS NULL"), "sentences")
    forms = with_forms(alike(rows)).select("section", "sentence", "n", "form", *(F.when(F.col("form").isNotNull(), c).alias(a) for a, c in (extra or {}).items()))
    forms = written(forms, "forms").where("form IS NOT NULL")
    return rows.select("study_id", "pos", "section", "sentence"), forms


def each_sentence(rows: DataFrame, forms: DataFrame, *columns: str) -> DataFrame:
    """The rows of sentences_with_forms() that map, with the named columns of their forms."""
    return frequent_join(rows, forms.select("section", "sentence", "n", *columns), ["section", "sentence"], "n").drop("n")


def first_capped(keyed: DataFrame, per_study: int | None) -> DataFrame:
    """The rows of keyed (study_id, pos, key, ...) that a reader in order keeps, with kept_no (0, 1, ... within the study).

    In order of (study_id, pos), a row is kept if no earlier kept row has its key and its study has
    fewer than per_study kept ones before it. Without per_study these are the first rows of the keys. Else rounds: a row is dropped once an earlier row of its key
    is kept, or per_study rows before it in its study are; it is kept once it is the first of its key
    that isn't dropped, and fewer than per_study rows before it in its study aren't dropped. The first
    undecided row of all is decided in each round, and as a rule nearly all rows are in one or two. Dropped rows say nothing about
    others and aren't written on."""
    place = F.struct("study_id", "pos")
    number = F.row_number().over(Window.partitionBy("study_id").orderBy("pos")) - 1
    if per_study is None:
        rest = [c for c in keyed.columns if c != "key"]
        firsts = keyed.groupBy("key").agg(F.min_by(F.struct(*rest), place).alias("r")).select("r.*", "key")
        return firsts.select(*keyed.columns, number.alias("kept_no"))
    slim = written(keyed.select("study_id", "pos", "key", F.lit(False).alias("kept")), "corpus-state")
    before = Window.partitionBy("study_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        firsts = slim.groupBy("key").agg(F.min(place).alias("first"), F.min(F.when(F.col("kept"), place)).alias("first_kept"), F.count(F.lit(1)).alias("n"))
        seen = _with_firsts(slim, written(firsts, "corpus-firsts")).withColumns({"sure": F.coalesce(F.sum(F.col("kept").cast("int")).over(before), F.lit(0)), "most": F.coalesce(F.count(F.lit(1)).over(before), F.lit(0))})
        drop = ~F.col("kept") & (F.coalesce(F.col("first_kept") < place, F.lit(False)) | (F.col("sure") >= per_study))
        keep = F.col("kept") | ((F.col("first") == place) & (F.col("most") < per_study))
        slim = written(seen.where(~drop).select("study_id", "pos", "key", keep.alias("kept")), "corpus-state")
        if not slim.where("NOT kept").limit(1).count():
            break
    return keyed.join(slim.select("study_id", "pos", "key", number.alias("kept_no")), ["study_id", "pos", "key"])


def _with_firsts(slim: DataFrame, firsts: DataFrame) -> DataFrame:
    """slim with the firsts of each key. The FREQUENT keys of most rows (sentences that most studies share) go by broadcast,
    a fixed number of rows, so no task gets all rows of such a key."""
    hot = firsts.orderBy(F.desc("n"), "key").limit(FREQUENT)
    keys = hot.select("key")
    rest = slim.join(F.broadcast(keys), "key", "left_anti").join(firsts.join(F.broadcast(keys), "key", "left_anti"), "key")
    return slim.join(F.broadcast(hot), "key").unionByName(rest)


def form_key() -> Column:
    """What tells the forms of a corpus apart."""
    return F.sha2(F.concat_ws("|", "section", logic.key(F.col("form.tree"))), 256)


def corpus(rows: DataFrame, per_study: int | None = PER_STUDY) -> DataFrame:
    """The rows of mapped() that the corpus keeps (first_capped), with kept_no and key: section and tree. Without per_study, rows may be those of alike()."""
    if per_study is not None and "n" in rows.columns:
        raise ValueError("a number for each study needs single sentences")
    return first_capped(rows.where("form IS NOT NULL").withColumn("key", form_key()), per_study)


def corpus_of(studies: DataFrame, per_study: int = PER_STUDY, **names: str) -> DataFrame:
    """corpus() of the studies, where each different sentence is mapped once."""
    rows, forms = sentences_with_forms(studies, {"key": form_key()}, **names)
    kept = first_capped(each_sentence(rows, forms, "key"), per_study)
    return frequent_join(kept, forms.select("section", "sentence", "n", "form"), ["section", "sentence"], "n").drop("n")


def criteria(rows: DataFrame, per_study: int | None = PER_STUDY, snapshot: str = "unknown", limit: int | None = None) -> DataFrame:
    """criterion_id, polarity, text, tree, depth and metadata of the corpus; with limit, of its first so many in order."""
    return criteria_of(corpus(rows, per_study), snapshot, limit)


def criteria_of(made: DataFrame, snapshot: str = "unknown", limit: int | None = None) -> DataFrame:
    """criteria() of the rows of a corpus."""
    if limit is not None:
        made = made.orderBy("study_id", "pos").limit(limit)
    ident = F.concat(F.lit("ctgov:"), F.col("study_id").cast("string"), F.lit(":"), F.substring("section", 1, 3), F.lit(":"), F.lpad(F.col("kept_no").cast("string"), F.greatest(F.lit(2), F.length(F.col("kept_no").cast("string"))), F.lit("0")))
    meta = F.create_map(
        F.lit("trial_id"), F.col("study_id").cast("string"), F.lit("section"), F.col("section"), F.lit("extraction_rule"), F.col("form.rule"),
        F.lit("snapshot_id"), F.lit(snapshot), F.lit("explicit_negation_cue"), F.when(F.col("form.negated"), "yes").otherwise("no"), F.lit("coverage"), F.lit("partial_predicate"))
    return made.select(ident.alias("criterion_id"), F.col("section").alias("polarity"), F.col("sentence").alias("text"), F.col("form.tree").alias("tree"), logic.depth(F.col("form.tree")).alias("depth"), meta.alias("metadata"))


def corpus_counts(rows: DataFrame, kept: DataFrame, per_study: int | None = PER_STUDY) -> DataFrame:
    """kind (total, skipped) and name, n of the sentences that the corpus looked at: those after a full study's last kept one don't count.

    Without per_study, rows may be those of alike()."""
    if per_study is not None and "n" in rows.columns:
        raise ValueError("a number for each study needs single sentences")
    reached = rows.withColumn("w", _weight(rows))
    if per_study is not None:
        ends = kept.groupBy("study_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("end")).where(F.col("n") >= per_study)
        reached = reached.join(ends.select("study_id", "end"), "study_id", "left").where(F.coalesce(F.col("pos") <= F.col("end"), F.lit(True)))
    ident = ["study_id", "pos", "section", "sentence"]
    state = reached.join(kept.select(*ident, F.lit(True).alias("kept"), (logic.depth(F.col("form.tree")) > 0).alias("grouped"), F.col("form.negated").alias("negated")), ident, "left")
    k = F.coalesce(F.col("kept"), F.lit(False))
    other = F.col("w") - k.cast("long")  # of a row that stands for several sentences, one is kept
    tag = lambda c, kind, name, n=F.lit(1).cast("long"): F.when(c, F.struct(F.lit(kind).alias("kind"), name.alias("name"), n.alias("n")))
    cells = F.array_compact(F.array(
        tag(F.lit(True), "total", F.lit("considered"), F.col("w")), tag(k, "total", F.lit("mapped")), tag(k & F.col("grouped"), "total", F.lit("mapped_coordinated")), tag(k & F.col("negated"), "total", F.lit("negated")),
        tag(other > 0, "skipped", F.coalesce("skipped", F.lit("duplicate_of_earlier_trial")), other),
    ))
    return state.select(F.explode(cells).alias("c")).groupBy("c.kind", "c.name").agg(F.sum("c.n").alias("n"))


def histogram(made: DataFrame, column: Column, alias: str) -> DataFrame:
    """How many criteria have each value of a column (polarity, depth)."""
    return made.groupBy(column.alias(alias)).agg(F.count(F.lit(1)).alias("n"))


def mapping_rate(counts: DataFrame) -> DataFrame:
    """One row: considered, mapped and rate (to 4 decimals) of corpus_counts()."""
    pick = lambda name: F.coalesce(F.sum(F.when((F.col("kind") == "total") & (F.col("name") == name), F.col("n"))), F.lit(0))
    one = counts.agg(pick("considered").alias("considered"), pick("mapped").alias("mapped"))
    return one.select("considered", "mapped", F.round(F.coalesce(F.try_divide("mapped", "considered"), F.lit(0.0)), 4).alias("rate"))


def composition(pool: DataFrame, made: DataFrame) -> DataFrame:
    """part (pool, corpus), measure and n: atoms, studies, sections and patterns of a pool (distinct_atoms), criteria,
    studies, polarities and depths of a corpus (criteria)."""
    cell = lambda part, measure: F.struct(F.lit(part).alias("part"), measure.alias("measure"))
    named = lambda name, value: F.concat(F.lit(name + ":"), value.cast("string"))
    atoms_ = pool.select(F.explode(F.array(cell("pool", F.lit("atoms")), cell("pool", named("section", F.col("section"))), cell("pool", named("pattern", F.col("hit.pattern"))))).alias("c"))
    forms = made.select(F.explode(F.array(cell("corpus", F.lit("criteria")), cell("corpus", named("polarity", F.col("polarity"))), cell("corpus", named("depth", F.col("depth"))))).alias("c"))
    out = atoms_.unionByName(forms).groupBy("c.part", "c.measure").agg(F.count(F.lit(1)).alias("n"))
    studies = pool.select(F.lit("pool").alias("part"), F.col("study_id").cast("string").alias("s")).unionByName(made.select(F.lit("corpus").alias("part"), F.col("metadata")["trial_id"].alias("s")))
    return out.unionByName(studies.distinct().groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.lit("studies").alias("measure"), "n"))


def pool_summary(found: DataFrame, pool: DataFrame, dates: DataFrame) -> DataFrame:
    """One row: atoms and studies of a pool (distinct_atoms), sentences considered and matched with the match rate (to 4 decimals, NULL of none), and
    the first and last date that one of its studies was posted. found: atoms() or with_atoms(); dates: study_id, first_posted."""
    matched = found.agg(F.coalesce(F.sum(_weight(found)), F.lit(0)).alias("considered"), F.coalesce(F.sum(F.when(F.col("hit").isNotNull(), _weight(found))), F.lit(0)).alias("matched"))
    studies = pool.groupBy("study_id").agg(F.count(F.lit(1)).alias("n"))
    posted = dates.groupBy("study_id").agg(F.min("first_posted").alias("first_posted"))
    one = studies.join(posted, "study_id", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_atoms"), F.count(F.lit(1)).alias("n_studies"), F.min("first_posted").alias("first_posted_from"), F.max("first_posted").alias("first_posted_to"))
    rate = F.round(F.try_divide("matched", "considered"), 4).alias("match_rate")
    return one.crossJoin(matched).select("n_atoms", "n_studies", "considered", "matched", rate, "first_posted_from", "first_posted_to")  # one row each
