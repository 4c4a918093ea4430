"""Test and result rows of a requisition, in four arrangements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labreports.functions import rules
from labreports.functions.ordering import SortKey, ascending
from labreports.operators.history import history_messages, may_have_large_tests
from labreports.plans.packing import pack, pack_more, unpack, unpack_first
from labreports.plans.scope import Related, few_rows, is_one_of, requisition_scope
from labreports.plans.skew import (
    LargeGroups,
    group_total,
    large_values,
    left_join_many,
    number_rows,
    sampled,
    stored_values,
)
from labreports.sources.warehouse import Tables

#: Rows with equal sort keys follow in this order, then by their remaining columns, so that only
#: rows that agree in every column tie.
_TIES = ascending(
    "lab_order_details_pk",
    "result_sequence",
    "result_test_code",
    "textual_result",
    "textual_result_full",
)

_MESSAGE_OF = ["requisition_id", "accession_number", "order_test_code"]


# What every report carries from the scans to the rows, beside the requisition. Values of one test, and
# those of one result, stand together, which compresses better.
_DETAIL_TEXTS = [
    "accession_number",
    "order_test_code",
    "ordered_name",
    "order_detail_status",
    "clinical_status",
    "order_control_reason",
]
_RESULT_TEXTS = [
    "result_test_code",
    "result_test_name",
    "result_order_name",
    "unit_of_measure",
    "reference_range",
    "textual_result",
    "textual_result_full",
    "result_sequence",
    "result_comment",
    "derived_abnormal_flag",
]

# What tells results apart, for sampling.
_RESULT_IDENTITY = [
    "lab_order_details_fk",
    "result_test_fk",
    "result_test_code",
    "result_sequence",
    "micro_isolate",
    "micro_sensitivity_name",
]


class _Report:
    """The rows that all four reports share, before their own columns and order."""

    def __init__(
        self,
        t: Tables,
        requisitions: DataFrame | None,
        micro: str,
        excluded_categories: list[str],
        result_tests: DataFrame | None = None,
        how: str = "inner",
        patient_group: bool = False,
    ):
        scope = requisition_scope(requisitions)
        scoped = scope.keep(t["dim_lab_order_details"], "requisition_id")
        related = scope.related(
            scoped, ["lab_order_details_pk", "lab_order_fk", "accession_number"]
        )
        narrowed = ["lab_order_details_fk", "lab_order_details_pk"]
        self.large = _large_requisitions(t, scoped, related.narrow(t["results"], *narrowed))
        tests = t["dim_order_test"].filter(
            (F.col("micro_culture_format_flag") == micro)
            & rules.not_in_keeping_null(F.col("order_test_type"), rules.EXCLUDED_ORDER_TEST_TYPES)
        )
        kept = rules.not_in_keeping_null(F.col("test_category"), excluded_categories)
        # Each side is shuffled for its test and then by detail; the key of the second shuffle is
        # taken out of the packed text between them.
        details = (
            t["dim_lab_order_details"]
            .filter(kept)
            .withColumnRenamed("order_test_name", "ordered_name")
            .join(t["lov_clinical_status"], "clinical_status", "left")
            .withColumn("clinical_status", F.coalesce("clinical_status_def", "clinical_status"))
            .transform(pack, "_detail", ["lab_order_details_pk", *_DETAIL_TEXTS])
        )
        details = (
            scope.keep(details, "requisition_id")
            .transform(pack_more, "_detail", ["requisition_id"])
            .join(
                tests.select(
                    F.col("order_test_pk").alias("order_test_fk"),
                    "inquiry_grouping",
                    F.col("source_lab_system").alias("test_lab_system"),
                ),
                "order_test_fk",
            )
        )
        detail_texts = [*_DETAIL_TEXTS, "requisition_id"]
        if patient_group:
            details = _with_patient_group(t, details, related)
        else:
            more = ["inquiry_grouping", "test_lab_system"]
            details = pack_more(details, "_detail", more)
            detail_texts += more
        details = unpack_first(details, "_detail", "lab_order_details_pk")
        # Without result tests the results are shuffled by detail at once.
        results = related.narrow(
            t["results"], *narrowed, at_once=result_tests is None
        ).withColumnsRenamed(
            {
                "lab_order_details_fk": "lab_order_details_pk",
                "lab_order_fk": "result_order_fk",
                "order_test_name": "result_order_name",
            }
        )
        kinds = {"result_sequence": "int"}
        result_texts = list(_RESULT_TEXTS)
        if not patient_group:
            result_texts.append("source_lab_system")
        unlisted = None
        if result_tests is not None and how == "inner":
            unlisted = _unlisted_tests(results, result_tests)
        if result_tests is None or unlisted is not None:
            results = pack(results, "_result", result_texts)
        else:
            results = pack(results, "_result", ["lab_order_details_pk", *result_texts])
            results = results.join(result_tests, "result_test_fk", how)
            results = unpack_first(results, "_result", "lab_order_details_pk")
        if unlisted is not None:
            test = F.col("result_test_fk")
            results = results.filter(test.isNotNull() & ~is_one_of(test, unlisted))
        rows = left_join_many(details, results, ["lab_order_details_pk"], self.large)
        if unlisted is not None:
            rows = pack_more(rows, "_detail", ["lab_order_details_pk"])
            detail_texts.append("lab_order_details_pk")
            rows = _with_result_tests(rows, result_tests)
        rows = unpack(rows, "_detail", detail_texts)
        rows = unpack(rows, "_result", result_texts, kinds)
        self.rows = rows.withColumns(
            {
                "order_test_name": F.coalesce("result_order_name", "ordered_name"),
                "result_test_name": F.coalesce("result_test_name", "ordered_name"),
                "original_result_test_name": F.col("result_test_name"),
                "abnormal_flag": F.col("derived_abnormal_flag"),
            }
        )
        # Built beside the join with the results, not ahead of it.
        split = self.large.any or may_have_large_tests(t, scoped)
        self._messages = history_messages(t, scoped, related, hot=self.large.any, split=split)

    def drop_collected_by(self) -> None:
        """Leave out the row that only names who collected the sample."""
        code = F.col("result_test_code")
        self.rows = self.rows.filter(rules.not_in_keeping_null(code, [rules.COLLECTED_BY_CODE]))

    def fill_in_missing_results(self) -> None:
        shown = rules.result_or_placeholder(
            F.col("textual_result_full"), F.col("order_detail_status")
        )
        self.rows = self.rows.withColumn("textual_result_full", shown)

    def _with_messages(self, rows: DataFrame) -> DataFrame:
        """Add the history message. Rows and messages share the shuffle by requisition that the numbering
        needs anyway, so wide rows are not shuffled for a join too; a large requisition has the join."""
        if self.large.any:
            return rows.join(self._messages, _MESSAGE_OF, "left")
        test = _MESSAGE_OF[1:]
        packs = ("string", "int", "bigint")
        kinds = {name: kind for name, kind in rows.dtypes if kind in packs and name not in _MESSAGE_OF}
        texts = list(kinds)
        kinds = {name: kind for name, kind in kinds.items() if kind != "string"}
        messages = pack(self._messages, "_test", test)
        both = pack(pack(rows, "_test", test), "_texts", texts)
        both = both.withColumn("_is_row", F.lit(True)).unionByName(messages, allowMissingColumns=True)
        # There is one message at most; none has a null in its keys.
        said = F.max("sh_msg").over(Window.partitionBy("requisition_id", "_test"))
        both = both.repartition("requisition_id").withColumn("sh_msg", said)
        both = both.filter("_is_row").drop("_is_row")
        return unpack(unpack(both, "_test", test), "_texts", texts, kinds)

    def finish(self, keys: list[SortKey], columns: list[str]) -> DataFrame:
        """Add the position and the number of sibling rows."""
        used = [key.column for key in keys]
        for tie in [*_TIES, *ascending(*columns)]:
            if tie.column not in used:
                keys = [*keys, tie]
                used.append(tie.column)
        kept = dict.fromkeys([*_MESSAGE_OF, *columns, *[key.column for key in keys]])
        rows = self._with_messages(self.rows.select(*kept))
        rows = rows.withColumn("sh_msg", F.coalesce("sh_msg", F.lit("-")))
        rows = number_rows(rows, "requisition_id", keys, "sort_position", self.large)
        siblings = ["requisition_id", "order_test_name"]
        rows = group_total(rows, siblings, F.count("*"), "parent_test_count", self.large)
        return rows.select(
            "requisition_id", "sort_position", *columns, "parent_test_count", "sh_msg"
        )


def _unlisted_tests(results: DataFrame, result_tests: DataFrame) -> list | None:
    """The tests of results that ``result_tests`` does not list, if they are few, else None."""
    tests = results.select("result_test_fk").filter(F.col("result_test_fk").isNotNull()).distinct()
    few = few_rows(tests.join(result_tests.select("result_test_fk"), "result_test_fk", "left_anti"))
    return None if few is None else [row[0] for row in few]


def _with_result_tests(rows: DataFrame, result_tests: DataFrame) -> DataFrame:
    """Add the columns of the results' tests to rows of which some have no result.

    Those have no test, and are dealt out by their detail, so that they do not meet in one task.
    """
    test = F.col("result_test_fk")
    one = F.lit(1).cast("bigint")
    rows = rows.withColumn("_dealt", F.when(test.isNull(), F.xxhash64("_detail")).otherwise(F.pmod(test, one)))
    tests = result_tests.withColumn("_dealt", F.pmod(test, one))
    return rows.join(tests, ["result_test_fk", "_dealt"], "left").drop("_dealt")


def _with_patient_group(t: Tables, details: DataFrame, related: Related) -> DataFrame:
    orders = related.narrow(t["dim_lab_order"], "lab_order_pk", "lab_order_fk", at_once=True)
    groups = orders.select(F.col("lab_order_pk").alias("lab_order_fk"), "patient_type").join(
        t["lov_patient_type"], "patient_type", "left"
    )
    return details.join(
        groups.select("lab_order_fk", "patient_type_sub_group"), "lab_order_fk", "left"
    )


def requisition_sample(details: DataFrame, results: DataFrame) -> DataFrame:
    """Sampled details by requisition, and sampled results by order."""
    by_detail = sampled(details, "lab_order_details_pk").select(
        "requisition_id", F.lit(None).cast("bigint").alias("order")
    )
    by_result = sampled(results, *_RESULT_IDENTITY).select(
        F.lit(None).cast("string").alias("requisition_id"), F.col("lab_order_fk").alias("order")
    )
    return by_detail.unionByName(by_result)


def _large_requisitions(t: Tables, details: DataFrame, results: DataFrame) -> LargeGroups:
    """Requisitions that many details or many results belong to.

    Results are counted by order, and only the large orders are looked up. An
    order that is not found still has to pass the join.
    """
    found = stored_values(t, "rows_of_requisition")
    if found is None:
        found = large_values(requisition_sample(details, t["results"]), "requisition_id", "order")
        # Narrowing results to many requisitions shuffles details, so it waits for a large order.
        if any(order is not None for _, order, _ in found):
            found = large_values(requisition_sample(details, results), "requisition_id", "order")
    requisition_of = {}
    orders = [order for _, order, _ in found if order is not None]
    if orders:
        named = t["dim_lab_order"].filter(F.col("lab_order_pk").isin(orders))
        requisition_of = dict(named.select("lab_order_pk", "requisition_id").collect())
    return LargeGroups(
        details.sparkSession,
        "requisition_id",
        [(key or requisition_of.get(order), rows) for key, order, rows in found],
    )


_DETAIL_COLUMNS = [
    "accession_number",
    "order_test_name",
    "result_test_name",
    "textual_result_full",
    "unit_of_measure",
    "reference_range",
    "abnormal_flag",
    "result_comment",
    "clinical_status",
    "order_control_reason",
]


def routine_test_details(t: Tables, requisitions: DataFrame | None = None) -> DataFrame:
    """Tests and results outside microbiology, by accession and test."""
    report = _Report(t, requisitions, "N", ["PENDING"], patient_group=True)
    report.drop_collected_by()
    report.fill_in_missing_results()
    return report.finish(
        ascending("accession_number", "ordered_name", "result_test_name"),
        [*_DETAIL_COLUMNS, "patient_type_sub_group"],
    )


def micro_test_details(t: Tables, requisitions: DataFrame | None = None) -> DataFrame:
    """Microbiology tests with their organisms and sensitivities."""
    sequences = t["dim_result_test"].select(
        F.col("result_test_pk").alias("result_test_fk"), "sequence_number"
    )
    report = _Report(
        t, requisitions, "Y", ["MISC", "PENDING"], sequences, "left", patient_group=True
    )
    is_collection_time = F.upper("original_result_test_name") == "COLLECTION TIME"
    report.rows = report.rows.withColumn(
        "seq_num", F.when(is_collection_time, 1).otherwise(F.col("sequence_number"))
    )
    return report.finish(
        ascending(
            "accession_number",
            "ordered_name",
            "seq_num",
            "micro_sensitivity_flag",
            "result_sequence",
        ),
        [
            *_DETAIL_COLUMNS,
            "patient_type_sub_group",
            "report_notes",
            "specimen_method_desc",
            "specimen_source_desc",
            "seq_num",
            "micro_isolate",
            "micro_organism_name",
            "micro_sensitivity_name",
            "micro_sensitivity_flag",
        ],
    )


def report_group_details(t: Tables, requisitions: DataFrame | None = None) -> DataFrame:
    """Tests and results by report group, the problem log first."""
    return _grouped_details(t, requisitions, [])


def status_details(t: Tables, requisitions: DataFrame | None = None) -> DataFrame:
    """Tests and results by clinical status, then by report group."""
    return _grouped_details(t, requisitions, ascending("status_rank"))


def _grouped_details(
    t: Tables, requisitions: DataFrame | None, first_keys: list[SortKey]
) -> DataFrame:
    result_tests = t["dim_result_test"].select(
        F.col("result_test_pk").alias("result_test_fk"), "sequence_number", "report_grouping"
    )
    report = _Report(t, requisitions, "N", ["PENDING"], result_tests)
    report.drop_collected_by()
    report.fill_in_missing_results()
    rows = report.rows.withColumns(
        {
            "own_grouping": F.col("report_grouping"),
            "report_grouping": F.coalesce("report_grouping", "inquiry_grouping"),
            "status_rank": rules.status_rank(F.col("clinical_status")),
        }
    )
    # The result's group and system come first; without an order for them, the
    # group shown is looked up under the ordered test's system.
    rows = _with_group_order(t, rows, "own_grouping", "source_lab_system", "own_order")
    rows = _with_group_order(t, rows, "report_grouping", "test_lab_system", "test_order")
    shown = F.col("report_grouping")
    report.rows = rows.withColumns(
        {
            "group_order": F.when(shown == rules.PROBLEM_LOG, rules.PROBLEM_LOG_ORDER).otherwise(
                F.coalesce("own_order", "test_order")
            ),
            "test_order_text": F.when(
                shown == rules.OTHER_TESTS, F.col("order_test_name")
            ).otherwise(rules.joined_text(F.col("sequence_number").cast("string"), "A")),
        }
    )
    return report.finish(
        first_keys
        + ascending("group_order", "report_grouping", "test_order_text", "result_test_name"),
        [*_DETAIL_COLUMNS, "report_grouping"],
    )


def _with_group_order(
    t: Tables, rows: DataFrame, grouping: str, system: str, name: str
) -> DataFrame:
    """Look up the sort order of a report group; a row whose group has two orders is an error."""
    orders = (
        t["lov_report_grouping"]
        .groupBy(F.col("report_grouping").alias(grouping), F.col("source_lab_system").alias(system))
        .agg(F.count("*").alias("_entries"), F.max("sort_order").alias(name))
    )
    twice = F.raise_error(F.lit("lov_report_grouping lists a report group twice"))
    checked = F.when(F.col("_entries") > 1, twice).otherwise(F.col(name))
    joined = rows.join(orders, [grouping, system], "left")
    return joined.withColumn(name, checked).drop("_entries")
