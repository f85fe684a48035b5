"""Registered queries: name -> (spark, folder of tables) -> DataFrame, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselink.functions.pairs import pair_features
from caselink.operators import analytics as an
from caselink.operators import ensemble, evaluation, id_search, linkage, prepare, similarity, tfidf
from caselink.plans import daily, evaluation_run, reports, views
from caselink.schema import FEATURES
from caselink.sources import cases as case_io
from caselink.sources import growing_index, lookup, models, text_index
from caselink.sources.scratch import write_table

Query = Callable[[SparkSession, str], DataFrame]

# Parameter values of the registered queries; the SQL counterparts use the same ones.
CATEGORY = "HIGH"
AREA = "NATION_13"
WEAPON = "MACHINERY"
ID_PATTERN = "1.3"
ID_PATTERNS = ("123", "1.3", "^12.*5$", "99$", "0{2}1", "(1|2)37", "44+1?", "^7$")
TOP_K = 20
SERVED_K = 10
LATEST = 1000
RECENT = 5000
DEEP_K = 50

QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return register


def _rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _index(spark: SparkSession, sf_dir: str, cases: DataFrame | None = None) -> text_index.TextIndex:
    cases = views.cases(spark, sf_dir) if cases is None else cases
    return text_index.load_or_fit(cases, views.scratch(spark, sf_dir, "text_index"))


def _stored_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases, joined and stored once for a query: fitting and ranking read them six times."""
    return write_table(views.cases(spark, sf_dir), views.scratch(spark, sf_dir, f"cases/{uuid.uuid4().hex}"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document cases, joined and stored once for a query: every read of the view would shuffle all texts."""
    return write_table(views.document_cases(spark, sf_dir), views.scratch(spark, sf_dir, f"document_cases/{uuid.uuid4().hex}"))


def _keyed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_documents`` with the key of each text in its place, for queries that compare texts and do not return them."""
    docs = views.document_cases(spark, sf_dir, keyed=True)
    return write_table(docs, views.scratch(spark, sf_dir, f"keyed_document_cases/{uuid.uuid4().hex}"))


def _document_index(spark: SparkSession, sf_dir: str, docs: DataFrame) -> text_index.TextIndex:
    """Of ``_keyed_documents``; the texts are read from the table of documents."""
    spelled = views.spelled_documents(spark, sf_dir)
    return text_index.load_or_fit_keyed(docs, spelled, views.scratch(spark, sf_dir, "keyed_document_index"))


def _trained(spark: SparkSession, sf_dir: str, docs: DataFrame, reuse: bool = True) -> ensemble.Ensemble:
    folder = views.scratch(spark, sf_dir, "ensemble")
    return evaluation_run.trained(lambda: _document_index(spark, sf_dir, docs), docs, folder, reuse=reuse)


def _model_folder(spark: SparkSession, sf_dir: str, docs: DataFrame) -> str:
    return evaluation_run.model_folder(docs, views.scratch(spark, sf_dir, "ensemble"))


# --- sources, cleaning -------------------------------------------------------------------------


@query("scan_raw_cases")
def scan_raw_cases(spark, sf_dir):
    return case_io.read_raw_cases(spark, views.raw_csv(spark, sf_dir))


@query("scan_cases")
def scan_cases(spark, sf_dir):
    path = views.scratch(spark, sf_dir, "clean_csv")
    case_io.write_cases(views.cases(spark, sf_dir), path, "csv")
    return case_io.read_cases(spark, path, "csv")


@query("normalize_headers")
def normalize_headers(spark, sf_dir):
    return case_io.normalize_headers(views.raw_export(spark, sf_dir))


@query("parse_dates")
def parse_dates(spark, sf_dir):
    return prepare.parse_dates(views.raw_cases(spark, sf_dir)).select("dr_no", "datetime")


@query("parse_dates_with_time")
def parse_dates_with_time(spark, sf_dir):
    return prepare.parse_dates(views.raw_cases(spark, sf_dir), keep_time=True).select("dr_no", "datetime")


@query("build_mo_text")
def build_mo_text(spark, sf_dir):
    return prepare.build_mo_text(views.raw_cases(spark, sf_dir)).select("dr_no", "mo_text")


@query("build_mo_text_no_weapon")
def build_mo_text_no_weapon(spark, sf_dir):
    return prepare.build_mo_text(views.raw_cases(spark, sf_dir).drop("weapon_desc")).select("dr_no", "mo_text")


@query("replace_sentinel")
def replace_sentinel(spark, sf_dir):
    raw = prepare.build_mo_text(views.raw_cases(spark, sf_dir))
    return prepare.replace_sentinel(raw).select("dr_no", "weapon_desc", "vict_sex", "mo_text")


@query("clean_cases")
def clean_cases(spark, sf_dir):
    raw = prepare.build_mo_text(prepare.parse_dates(views.raw_cases(spark, sf_dir)))
    return case_io.with_case_types(prepare.clean_cases(raw))


@query("recent_cases")
def recent_cases(spark, sf_dir):
    cases = views.cases(spark, sf_dir)
    return prepare.recent_cases(write_table(cases, views.scratch(spark, sf_dir, "recent")), RECENT)


@query("latest_cases")
def latest_cases(spark, sf_dir):
    return prepare.recent_cases(views.timed_cases(spark, sf_dir), LATEST)


@query("prepare_cases")
def prepare_cases(spark, sf_dir):
    return prepare.prepare_cases(case_io.read_raw_cases(spark, views.raw_csv(spark, sf_dir)))


@query("prepare_recent_cases")
def prepare_recent_cases(spark, sf_dir):
    return prepare.prepare_cases(case_io.read_raw_cases(spark, views.raw_csv(spark, sf_dir)), RECENT)


@query("deduplicated_cases")
def deduplicated_cases(spark, sf_dir):
    return prepare.deduplicated_cases(case_io.with_case_types(prepare.build_mo_text(prepare.parse_dates(views.raw_cases(spark, sf_dir)))))


@query("dropped_rows")
def dropped_rows(spark, sf_dir):
    return prepare.dropped_rows(views.raw_cases(spark, sf_dir))


@query("case_detail")
def case_detail(spark, sf_dir):
    asked = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dr_no"))
    return an.case_detail(an.lookup_cases(views.cases(spark, sf_dir), asked))


@query("case_detail_by_lot")
def case_detail_by_lot(spark, sf_dir):
    path = views.scratch(spark, sf_dir, "lookup")
    lookup.write_lookup(views.cases(spark, sf_dir), path)
    asked = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dr_no"))
    return an.case_detail(lookup.lookup(spark, path, asked))


@query("search_case_ids")
def search_case_ids(spark, sf_dir):
    return an.search_case_ids(views.cases(spark, sf_dir), ID_PATTERN)


@query("checked_raw_cases")
def checked_raw_cases(spark, sf_dir):
    rows, _ = case_io.read_checked_cases(spark, views.broken_csv(spark, sf_dir), views.RAW_HEADERS)
    return rows


@query("rejected_lines")
def rejected_lines(spark, sf_dir):
    rows, rejected = case_io.read_checked_cases(spark, views.broken_csv(spark, sf_dir), views.RAW_HEADERS)
    taken = rows.agg(F.lit("accepted").alias("reason"), F.count(F.lit(1)).alias("lines"))
    return taken.unionByName(rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("lines")))


@query("search_ids_indexed")
def search_ids_indexed(spark, sf_dir):
    cases = views.cases(spark, sf_dir)
    grams = id_search.write_id_grams(cases, views.scratch(spark, sf_dir, "id_grams"))
    found = [
        id_search.search_ids_by_grams(grams, cases, p).select(F.lit(p).alias("pattern"), "dr_no") for p in ID_PATTERNS
    ]
    return reduce(DataFrame.unionByName, found)


# --- analytics ---------------------------------------------------------------------------------


@query("summary_metrics")
def summary_metrics(spark, sf_dir):
    return an.summary_metrics(views.cases(spark, sf_dir))


@query("top_areas")
def top_areas(spark, sf_dir):
    return an.top_areas(views.cases(spark, sf_dir), 5)


@query("top_areas_10")
def top_areas_10(spark, sf_dir):
    return an.top_areas(views.cases(spark, sf_dir), 10)


@query("top_weapons")
def top_weapons(spark, sf_dir):
    return an.top_weapons(views.cases(spark, sf_dir), 5)


@query("top_weapons_10")
def top_weapons_10(spark, sf_dir):
    return an.top_weapons(views.cases(spark, sf_dir), 10)


@query("top_crime_types")
def top_crime_types(spark, sf_dir):
    return an.top_crime_types(views.cases(spark, sf_dir))


@query("recent_in_category")
def recent_in_category(spark, sf_dir):
    return an.recent_in_category(views.cases(spark, sf_dir), CATEGORY)


@query("monthly_trend")
def monthly_trend(spark, sf_dir):
    return an.monthly_trend(views.cases(spark, sf_dir))


@query("age_groups")
def age_groups(spark, sf_dir):
    return an.age_groups(views.cases(spark, sf_dir))


@query("sex_breakdown")
def sex_breakdown(spark, sf_dir):
    return an.sex_breakdown(views.cases(spark, sf_dir))


@query("sex_breakdown_pct")
def sex_breakdown_pct(spark, sf_dir):
    return _rounded(an.with_share(an.sex_breakdown(views.cases(spark, sf_dir))), ["share"])


@query("day_of_week")
def day_of_week(spark, sf_dir):
    return an.day_of_week(views.timed_cases(spark, sf_dir))


@query("hour_of_day")
def hour_of_day(spark, sf_dir):
    return an.hour_of_day(views.timed_cases(spark, sf_dir))


@query("yoy_trend")
def yoy_trend(spark, sf_dir):
    return an.yoy_trend(views.cases(spark, sf_dir))


@query("yoy_trend_long")
def yoy_trend_long(spark, sf_dir):
    return an.yoy_trend_long(views.cases(spark, sf_dir))


@query("same_crime_counts")
def same_crime_counts(spark, sf_dir):
    return an.same_crime_counts(views.cases(spark, sf_dir))


@query("analytics_report")
def analytics_report(spark, sf_dir):
    return reports.analytics_report(views.cases(spark, sf_dir), views.scratch(spark, sf_dir, "chart_counts"))


@query("metrics_report")
def metrics_report(spark, sf_dir):
    return reports.headline_report(views.cases(spark, sf_dir), views.scratch(spark, sf_dir, "headline_counts"))


# --- text --------------------------------------------------------------------------------------


@query("tokenize_text")
def tokenize_text(spark, sf_dir):
    return tfidf.tokenize(views.documents(spark, sf_dir), ["dr_no"])


@query("term_frequency")
def term_frequency(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    texts = tfidf.distinct_texts(docs)
    return tfidf.per_case(docs, texts, tfidf.term_counts(texts), cases_are_all=True).select("dr_no", "term", "tf")


@query("idf")
def idf(spark, sf_dir):
    texts = tfidf.distinct_texts(views.documents(spark, sf_dir))
    table = tfidf.inverse_document_frequency(tfidf.term_counts(texts), texts)
    return _rounded(table.select("term", "df", "idf"), ["idf"])


@query("tfidf_weights")
def tfidf_weights(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    index = text_index.fit(docs, path=views.scratch(spark, sf_dir, "document_index"), with_leaders=False)
    return _rounded(tfidf.per_case(docs, index.texts, index.weights, cases_are_all=True).select("dr_no", "term", "weight"), ["weight"])


@query("appended_tfidf_weights")
def appended_tfidf_weights(spark, sf_dir):
    """Weights of an index to which three parts of the documents were appended one after another."""
    docs = _documents(spark, sf_dir)
    path = views.scratch(spark, sf_dir, "growing_index")
    for part in range(3):
        growing_index.append(docs.filter(F.pmod("dr_no", F.lit(3)) == part), path, f"part-{part}")
    index = growing_index.load(spark, path)
    return _rounded(tfidf.per_case(docs, index.texts, index.weights, cases_are_all=True).select("dr_no", "term", "weight"), ["weight"])


@query("case_tfidf_weights")
def case_tfidf_weights(spark, sf_dir):
    cases = views.cases(spark, sf_dir)
    index = _index(spark, sf_dir)
    return _rounded(tfidf.per_case(cases, index.texts, index.weights, cases_are_all=True).select("dr_no", "term", "weight"), ["weight"])


@query("tfidf_stats")
def tfidf_stats(spark, sf_dir):
    texts = tfidf.distinct_texts(views.documents(spark, sf_dir))
    return tfidf.corpus_stats(texts, tfidf.term_counts(texts))


@query("tfidf_roundtrip")
def tfidf_roundtrip(spark, sf_dir):
    _index(spark, sf_dir)
    saved = _index(spark, sf_dir)
    texts = saved.texts.select("text_id", "mo_text")
    return _rounded(saved.weights.join(texts, "text_id").select("mo_text", "term", "weight"), ["weight"])


# --- similar cases -----------------------------------------------------------------------------


@query("cosine_similarity")
def cosine_similarity(spark, sf_dir):
    cases = views.cases(spark, sf_dir)
    latest = cases.orderBy(F.desc("datetime"), F.asc("dr_no")).limit(1)
    return _rounded(similarity.cosine_to_all(_index(spark, sf_dir), latest, cases), ["similarity"])


@query("candidate_pool")
def candidate_pool(spark, sf_dir):
    index = _index(spark, sf_dir)
    pool = similarity.candidate_pool(index, None, similarity.pool_size(TOP_K))
    texts = index.texts.select(F.col("text_id").alias("q_text"), "mo_text")
    rows = pool.join(texts, "q_text").select("mo_text", "pool_rank", "cand.dr_no", "similarity")
    return _rounded(rows, ["similarity"])


def _similar(spark, sf_dir, k, cases=None, **options):
    cases = views.cases(spark, sf_dir) if cases is None else cases
    return similarity.similar_cases(_index(spark, sf_dir, cases), cases, k, bases_are_all=True, **options)


@query("similar_cases")
def similar_cases(spark, sf_dir):
    return _rounded(similarity.as_served(_similar(spark, sf_dir, TOP_K)), ["similarity"])


@query("similar_by_area")
def similar_by_area(spark, sf_dir):
    return _rounded(similarity.as_served(_similar(spark, sf_dir, SERVED_K, area=AREA)), ["similarity"])


@query("similar_by_weapon")
def similar_by_weapon(spark, sf_dir):
    return _rounded(similarity.as_served(_similar(spark, sf_dir, SERVED_K, weapon=WEAPON)), ["similarity"])


@query("similar_by_area_deep")
def similar_by_area_deep(spark, sf_dir):
    return _rounded(similarity.as_served(_similar(spark, sf_dir, DEEP_K, area=AREA)), ["similarity"])


@query("similar_documents")
def similar_documents(spark, sf_dir):
    docs = _keyed_documents(spark, sf_dir)
    index = _document_index(spark, sf_dir, docs)
    found = similarity.similar_cases(index, docs, TOP_K, bases_are_all=True, pruned=True)
    return _rounded(found.select(*_pair_ids(), "rank", "similarity"), ["similarity"])


def _within(spark, sf_dir, field, value):
    found = similarity.similar_within(
        _index(spark, sf_dir), views.cases(spark, sf_dir), TOP_K, field, value, views.scratch(spark, sf_dir, "leaders_by"), bases_are_all=True
    )
    return _rounded(similarity.as_served(found), ["similarity"])


@query("similar_within_area")
def similar_within_area(spark, sf_dir):
    return _within(spark, sf_dir, "area_name", AREA)


@query("similar_within_weapon")
def similar_within_weapon(spark, sf_dir):
    return _within(spark, sf_dir, "weapon_desc", WEAPON)


# --- pairs, training ---------------------------------------------------------------------------


def _pair_ids() -> list:
    return [F.col("base.dr_no").alias("q_id"), F.col("cand.dr_no").alias("dr_no")]


@query("pair_features")
def features_of_pairs(spark, sf_dir):
    rows = _similar(spark, sf_dir, SERVED_K)
    columns = pair_features(F.col("similarity"), F.col("base"), F.col("cand"))
    return _rounded(
        rows.select(*_pair_ids(), *[columns[f].alias(f) for f in FEATURES]), ["similarity", "time_decay"]
    )


@query("relevance_labels")
def relevance_labels(spark, sf_dir):
    return linkage.with_label(_similar(spark, sf_dir, SERVED_K)).select(*_pair_ids(), "label")


@query("training_sample")
def training_sample(spark, sf_dir):
    return linkage.sample_cases(views.cases(spark, sf_dir), evaluation_run.TRAINING_CASES).select("dr_no")


def _training_pairs(spark, sf_dir):
    cases = views.cases(spark, sf_dir)
    return linkage.training_pairs(_index(spark, sf_dir), cases, evaluation_run.TRAINING_CASES)


@query("training_pairs")
def training_pairs(spark, sf_dir):
    rows = _training_pairs(spark, sf_dir).select(*_pair_ids(), *FEATURES, "label")
    return _rounded(rows, ["similarity", "time_decay"])


@query("training_label_rate")
def training_label_rate(spark, sf_dir):
    return _rounded(linkage.label_rate(_training_pairs(spark, sf_dir)), ["positive_rate"])


# --- ensemble ----------------------------------------------------------------------------------


@query("document_training_pairs")
def document_training_pairs(spark, sf_dir):
    docs = _keyed_documents(spark, sf_dir)
    pairs = linkage.training_pairs(_document_index(spark, sf_dir, docs), docs, evaluation_run.TRAINING_CASES)
    return _rounded(pairs.select(*_pair_ids(), *FEATURES, "label"), ["similarity", "time_decay"])


@query("train_ensemble")
def train_ensemble(spark, sf_dir):
    docs = _keyed_documents(spark, sf_dir)
    model = _trained(spark, sf_dir, docs, reuse=False)
    pairs = spark.read.parquet(_model_folder(spark, sf_dir, docs) + "/pairs")
    return ensemble.score(pairs, model).select(*_pair_ids(), "label", "p_rf", "p_gb", "score")


@query("feature_importances")
def feature_importances(spark, sf_dir):
    return ensemble.importances(_trained(spark, sf_dir, _keyed_documents(spark, sf_dir)), spark)


@query("score_pairs")
def score_pairs(spark, sf_dir):
    pairs = linkage.with_features(_similar(spark, sf_dir, SERVED_K, _stored_cases(spark, sf_dir)))
    return ensemble.score(pairs, _trained(spark, sf_dir, _keyed_documents(spark, sf_dir)), many=True).select(*_pair_ids(), "p_rf", "p_gb", "score")


@query("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    docs = _keyed_documents(spark, sf_dir)
    _trained(spark, sf_dir, docs)
    folder = _model_folder(spark, sf_dir, docs)
    saved = models.load(spark, f"{folder}/model")
    return ensemble.score(spark.read.parquet(f"{folder}/pairs"), saved).select(*_pair_ids(), "score")


@query("ranked_cases")
def ranked_cases(spark, sf_dir):
    cases = _stored_cases(spark, sf_dir)
    index = _index(spark, sf_dir, cases)
    model = _trained(spark, sf_dir, _keyed_documents(spark, sf_dir))
    return ensemble.as_served(ensemble.rank_all_cases(index, cases, model, SERVED_K))


# --- evaluation --------------------------------------------------------------------------------


def _case_metrics(spark, sf_dir):
    cases = views.cases(spark, sf_dir)
    return evaluation.similarity_metrics(_index(spark, sf_dir), cases, cases, bases_are_all=True)


def _metric_query(name: str, column: str) -> None:
    @query(name)
    def metric(spark, sf_dir):
        return _rounded(_case_metrics(spark, sf_dir).select("dr_no", "k", column), [column])


for _name, _column in (("precision_at_k", "precision"), ("recall_at_k", "recall"), ("f1_at_k", "f1"), ("ndcg_at_k", "ndcg")):
    _metric_query(_name, _column)


@query("relevant_counts")
def relevant_counts(spark, sf_dir):
    cases = views.cases(spark, sf_dir)
    return evaluation.with_relevant_count(cases, cases).select("dr_no", "relevant")


@query("true_recall_at_k")
def true_recall_at_k(spark, sf_dir):
    cases = views.cases(spark, sf_dir)
    return _rounded(evaluation.true_recalls(_index(spark, sf_dir), cases, cases, bases_are_all=True), ["recall"])


@query("held_out_samples")
def held_out_samples(spark, sf_dir):
    """Ids that training and evaluation draw when they are kept apart."""
    docs = _documents(spark, sf_dir)
    held = linkage.held_out()
    drawn = lambda df, n, side: linkage.sample_cases(df, n).select("dr_no", F.lit(side).alias("side"))
    training = drawn(docs.filter(~held), evaluation_run.TRAINING_CASES, "training")
    return training.unionByName(drawn(docs.filter(held), evaluation_run.OFFLINE["eval_cases"], "evaluation"))


@query("map_at_k")
def map_at_k(spark, sf_dir):
    cases = views.cases(spark, sf_dir)
    per_case = evaluation.average_precisions(_index(spark, sf_dir), cases, TOP_K, bases_are_all=True)
    return _rounded(evaluation.mean_average_precision(per_case), ["map"])


@query("evaluate_similarity")
def evaluate_similarity(spark, sf_dir):
    means = evaluation.mean_metrics(_case_metrics(spark, sf_dir))
    return _rounded(means, ["precision", "recall", "f1", "ndcg"])


@query("evaluate_sample")
def evaluate_sample(spark, sf_dir):
    docs = _keyed_documents(spark, sf_dir)
    bases = linkage.stored_sample(docs, evaluation_run.OFFLINE["eval_cases"])
    index = _document_index(spark, sf_dir, docs)
    means = evaluation.mean_metrics(
        evaluation.similarity_metrics(index, bases, docs, evaluation_run.OFFLINE["k_values"])
    )
    return _rounded(means, ["precision", "recall", "f1", "ndcg"])


@query("compare_models")
def compare_models(spark, sf_dir):
    docs = _keyed_documents(spark, sf_dir)
    index = _document_index(spark, sf_dir, docs)
    return evaluation_run.compare_rankings(index, docs, _trained(spark, sf_dir, docs), **evaluation_run.OFFLINE)


@query("compare_models_served")
def compare_models_served(spark, sf_dir):
    docs = _keyed_documents(spark, sf_dir)
    index = _document_index(spark, sf_dir, docs)
    return evaluation_run.compare_rankings(index, docs, _trained(spark, sf_dir, docs), **evaluation_run.SERVED)


# --- properties of the model side that SQL can follow ------------------------------------------


def _probable(*columns: str):
    """Whether all are probabilities and ``score`` is the mean of the first two."""
    within = F.lit(True)
    for c in columns:
        within = within & F.col(c).between(0, 1)
    return within & (F.abs(F.col("score") - (F.col("p_rf") + F.col("p_gb")) / 2) < 1e-12)


# --- store by day --------------------------------------------------------------------------------

GRAIN = "month"
LATE_SINCE = "2000-07-01"


def _daily_store(spark: SparkSession, sf_dir: str, name: str) -> str:
    """All cases, the last year's at first without weapon, sex and age, then replaced by the whole ones."""
    path = views.scratch(spark, sf_dir, f"daily_{name}")
    cases = write_table(views.cases(spark, sf_dir), views.scratch(spark, sf_dir, f"daily_{name}_source"))
    late = F.col("datetime") >= F.lit(LATE_SINCE).cast("timestamp_ntz")
    raw = {c: F.when(~late, F.col(c)) for c in ("weapon_desc", "vict_sex", "vict_age")}
    daily.replace(cases.withColumns(raw), path, GRAIN)
    daily.replace(cases.filter(late), path, GRAIN)
    return path


@query("daily_analytics_report")
def daily_analytics_report(spark, sf_dir):
    path = _daily_store(spark, sf_dir, "report")
    return daily.analytics_report(spark, path, views.scratch(spark, sf_dir, "daily_report_counts"), grain=GRAIN)


@query("daily_summary")
def daily_summary(spark, sf_dir):
    """Approximate distinct ids are compared with the number of cases, which are unique here."""
    figures = daily.summary(spark, _daily_store(spark, sf_dir, "summary"), grain=GRAIN)
    close = F.abs(F.col("distinct_ids") - F.col("total_cases")) <= 0.03 * F.col("total_cases")
    return figures.select("total_cases", "distinct_areas", "crime_types", close.alias("ids_close"), "min_date", "max_date")


@query("daily_latest_cases")
def daily_latest_cases(spark, sf_dir):
    return daily.latest_cases(spark, _daily_store(spark, sf_dir, "latest"), RECENT)


@query("train_ensemble_checked")
def train_ensemble_checked(spark, sf_dir):
    scored = train_ensemble(spark, sf_dir)
    return scored.select("q_id", "dr_no", "label", _probable("p_rf", "p_gb", "score").alias("sound"))


@query("score_pairs_checked")
def score_pairs_checked(spark, sf_dir):
    return score_pairs(spark, sf_dir).select("q_id", "dr_no", _probable("p_rf", "p_gb", "score").alias("sound"))


@query("feature_importances_checked")
def feature_importances_checked(spark, sf_dir):
    total = lambda c: F.round(F.sum(c), 6).alias(c)
    return feature_importances(spark, sf_dir).agg(
        F.array_join(F.sort_array(F.collect_set("feature")), ",").alias("features"), total("rf"), total("gb"), total("avg")
    )


@query("model_roundtrip_checked")
def model_roundtrip_checked(spark, sf_dir):
    """Pairs whose score is another after the model was saved and loaded."""
    docs = _keyed_documents(spark, sf_dir)
    model = _trained(spark, sf_dir, docs, reuse=False)
    folder = _model_folder(spark, sf_dir, docs)
    pairs = spark.read.parquet(f"{folder}/pairs")
    again = ensemble.score(ensemble.score(pairs, model).withColumnsRenamed({"score": "before"}).drop("p_rf", "p_gb"), models.load(spark, f"{folder}/model"))
    changed = F.count(F.when(F.col("score") != F.col("before"), 1))
    return again.agg(F.count(F.lit(1)).alias("pairs"), changed.alias("changed"))


@query("ranked_cases_checked")
def ranked_cases_checked(spark, sf_dir):
    """Per base: length of its list, its last rank, how often it is on its own list, rows whose features are all there."""
    explained = F.count(F.when(F.col("features.time_decay").isNotNull() & F.col("features.age_difference").isNotNull(), 1))
    return ranked_cases(spark, sf_dir).groupBy("q_id").agg(
        F.count(F.lit(1)).alias("hits"),
        F.max("rank").alias("last_rank"),
        F.count(F.when(F.col("dr_no") == F.col("q_id"), 1)).alias("own"),
        explained.alias("explained"),
    )


def _base_side(compared: DataFrame) -> DataFrame:
    names = ["base_precision", "base_recall", "base_ndcg"]
    return _rounded(compared.select("k", *names), names)


@query("compare_models_checked")
def compare_models_checked(spark, sf_dir):
    return _base_side(compare_models(spark, sf_dir))


@query("compare_models_served_checked")
def compare_models_served_checked(spark, sf_dir):
    return _base_side(compare_models_served(spark, sf_dir))
