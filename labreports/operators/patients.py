"""Finding patients and showing one of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labreports.functions import rules
from labreports.functions.ordering import SortKey, ascending
from labreports.plans.scope import FEW, Scope, few_rows, is_one_of, narrow
from labreports.plans.skew import SEEN, LargeGroups, group_total, least_large, number_rows, sampled
from labreports.sources.warehouse import Tables

# Accounts that make a facility's patients searchable.
_ACCOUNT_TYPES = [
    "STUDY",
    "DRAW STATION",
    "IN-HOUSE EAST",
    "IN-HOUSE WEST",
    "SPECTRA WEST",
    "SPECTRA EAST",
]
_ACCOUNT_STATUSES = ["ACTIVE", "IN PROGRESS", "TRANSFERRED"]
_DOB_FORMAT = "MMddyyyy"
#: Letters of a name that searches are looked up by; the whole pattern is checked afterwards.
_BLOCK = 3
#: Letters that this many names hold are looked up in twos.
COMMON = 1 << 20
_KINDS = ("facility", "born", "start", "piece", "pair", "all")
_BY_NAME = ("start", "piece")
#: Up to this many groups of letters are sought in a name one by one; beyond it a name is cut into its own.
_SOUGHT = 32


def name_pattern(name: Column) -> Column:
    """LIKE pattern of a typed name; null if nothing was typed.

    Blanks match anything between words, and so does a leading blank. Typed
    ``%`` and ``_`` stay wildcards; a backslash is an ordinary character.
    """
    words = F.regexp_replace(F.regexp_replace(name, r"\s+", " "), r"\s", "%")
    pattern = F.upper(F.trim(words))
    pattern = F.when(pattern.endswith("%"), pattern).otherwise(F.concat(pattern, F.lit("%")))
    return F.when(F.length(name) > 0, pattern)


def patient_search(
    t: Tables,
    searches: DataFrame,
    sort_field: str | None = None,
    descending: bool = False,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Patients that match each search, numbered in the order asked for.

    ``searches`` has ``search_id``, ``name``, ``facility_id`` and ``dob`` (text,
    month, day and year as eight digits); an empty one does not filter. ``keys``
    is a stored ``patient_keys``; with it a search is looked up by its rarest key
    and no sample is drawn unless a key is common.
    """
    asked = _Searches(searches, t["dim_patient"], keys)
    matches = asked.matches(t["dim_patient"])
    last_labs = t["agg_patient_max_general_lab_mv"].join(
        t["dim_date"].withColumnRenamed("date_pk", "collection_date_fk"), "collection_date_fk"
    )
    qualifying = (
        t["dim_account"]
        .filter(
            F.col("account_type").isin(_ACCOUNT_TYPES)
            & F.upper("account_status").isin(_ACCOUNT_STATUSES)
        )
        .select("facility_fk")
        .distinct()
    )
    sites = _sites(t, F.col("display_name")).join(qualifying, "facility_fk", "left_semi")
    masters = t["spectra_mrn_master"].select(
        F.col("spectra_mrn_pk").alias("spectra_mrn_fk"), "mrn_status"
    )
    rows = (
        matches.join(sites, "facility_fk")
        .join(masters, "spectra_mrn_fk")
        .filter(~F.col("filtered") | (F.col("mrn_status") == "ACTIVE"))
        .join(
            last_labs.select(
                F.col("patient_fk").alias("patient_pk"), F.col("day").alias("last_general_lab_date")
            ),
            "patient_pk",
        )
    )
    rows = _with_modality_and_physician(t, rows).withColumns(
        {
            "corp_name": F.col("client_name"),
            "facility_name": rules.joined_text(
                F.col("client_acronym"), " - ", F.col("shown_name")
            ),
            "mrn_number": F.col("spectra_mrn").cast("bigint"),
        }
    )
    large = asked.large_groups(t["dim_patient"])
    rows, order = _with_sort_keys(rows, sort_field, descending)
    shown = [c for c in _SEARCH_COLUMNS if c != "spectra_mrn"]
    # Rows that tie in the whole order agree in all columns that are shown.
    used = [key.column for key in order]
    order = [*order, *ascending(*[c for c in ["mrn_number", *shown] if c not in used])]
    rows = rows.select("search_id", *[key.column for key in order], "spectra_mrn")
    rows = number_rows(rows, "search_id", order, "sl_no", large)
    rows = group_total(rows, ["search_id"], F.count("spectra_mrn"), "total_entity_cnt", large)
    rows = rows.withColumn("spectra_mrn", F.col("mrn_number"))
    return rows.select("search_id", "sl_no", "total_entity_cnt", *_SEARCH_COLUMNS)


_SEARCH_COLUMNS = [
    "corp_name",
    "facility_name",
    "facility_id",
    "fmc_number",
    "full_name",
    "dob",
    "gender",
    "last_general_lab_date",
    "modality",
    "spectra_mrn",
    "external_mrn",
    "physician_name",
    "lab",
    "patient_type",
    "facility_fk",
]


def name_start() -> Column:
    """The first letters of ``upper_name``."""
    return F.substring("upper_name", 1, _BLOCK)


def name_pieces() -> Column:
    """All groups of three letters in a row that ``upper_name`` holds; null if it is shorter."""
    letters = F.sequence(F.lit(1), F.length("upper_name") - (_BLOCK - 1))
    pieces = F.transform(letters, lambda at: F.substr("upper_name", at, F.lit(_BLOCK)))
    return F.when(F.length("upper_name") >= _BLOCK, F.array_distinct(pieces))


def _held(values: list[str]) -> Column:
    """Those of ``values``, one group of three letters each or several together, of which ``upper_name``
    holds all letters."""

    def holds(value: Column, places: int) -> Column:
        found = F.contains("upper_name", F.substring(value, 1, _BLOCK))
        for k in range(1, places):
            found = found & F.contains("upper_name", F.substring(value, 1 + k * _BLOCK, _BLOCK))
        return found

    none = F.array().cast("array<string>")
    if not values:
        return none
    places = len(values[0]) // _BLOCK
    if places == 1 and len(values) > _SOUGHT:
        return F.filter(F.coalesce(name_pieces(), none), lambda piece: piece.isin(values))
    return F.filter(F.array(*map(F.lit, values)), lambda value: holds(value, places))


def _terms(searches: DataFrame) -> DataFrame:
    """Each search with what it filters by, and the key that it looks patients up by: the facility,
    the birth date, the start of the name, or else three letters that the name holds, of which the
    rarest are chosen later. Only a search with none of these has to meet every patient."""
    pattern = name_pattern(F.col("name"))
    dob_text = F.when(F.length("dob") > 0, F.col("dob"))
    runs = F.regexp_extract_all("pattern", F.lit(f"[^%_]{{{_BLOCK},}}"), F.lit(0))

    def pieces_of(run: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(run) - (_BLOCK - 1))
        return F.transform(places, lambda at: F.substr(run, at, F.lit(_BLOCK)))

    terms = searches.select(
        "search_id",
        pattern.alias("pattern"),
        F.when(F.col("facility_id") > 0, F.col("facility_id").cast("bigint")).alias("at_facility"),
        dob_text.alias("dob_text"),
        F.try_to_timestamp(dob_text, F.lit(_DOB_FORMAT)).cast("date").alias("born"),
    ).withColumns(
        {
            "start": F.regexp_extract("pattern", "^[^%_]*", 0),
            "plain": F.col("pattern").rlike("^[^%_]*%$"),
            "pieces": F.array_distinct(F.flatten(F.transform(runs, pieces_of))),
            "filtered": F.coalesce("pattern", "dob_text").isNotNull()
            | F.col("at_facility").isNotNull(),
        }
    )
    by = (
        F.when(F.col("at_facility").isNotNull(), "facility")
        .when(F.col("dob_text").isNotNull(), "born")
        .when(F.length("start") >= _BLOCK, "start")
        .when(F.size("pieces") > 0, "piece")
        .otherwise("all")
    )
    terms = terms.withColumn("by", by)
    return terms.withColumn(
        "value",
        F.when(F.col("by") == "facility", F.col("at_facility").cast("string"))
        .when(F.col("by") == "born", F.col("born").cast("string"))
        .when(F.col("by") == "start", F.substring("start", 1, _BLOCK))
        .when(F.col("by") == "all", ""),
    )


class _Searches:
    """The searches of a call with the key that each looks patients up by.

    A search for letters inside a name takes the rarest three of its pattern: how many names hold
    them is counted for the letters asked for, or read from the stored ``keys``. If even those are
    common, it takes the two rarest at once. With stored keys, so does a search whose first letters
    are common. Searches without a key are dealt in copies against as many splits of the patients,
    so that no task meets all of them.

    Only kinds of keys that a search has are joined, and of few searches only the values asked for
    leave the scan of the patients.
    """

    def __init__(self, searches: DataFrame, patients: DataFrame, keys: DataFrame | None):
        terms = _terms(searches)
        self._spark, self._keys = searches.sparkSession, keys
        few = few_rows(terms.select("by", "value", "at_facility", "born", "pattern", "pieces"))
        self._few, self._asked = few, None
        if few is None:
            used = {row.by for row in terms.select("by").distinct().collect()}
            self.terms = self._with_rarest(terms, patients) if "piece" in used else terms
        else:
            chosen = self._chosen(few, patients)
            keys = {
                chosen.get(row.pattern, (row.by, row.value)) if row.by in _BY_NAME else (row.by, row.value)
                for row in few
            }
            used = {by for by, _ in keys}
            self._asked = {
                kind: sorted({value for by, value in keys if by == kind and value is not None})
                for kind in _KINDS
            }
            # There are no more rows than that, and so Spark knows it when it chooses the joins.
            self.terms = self._with_chosen(terms, chosen).limit(FEW)
        self.kinds = tuple(kind for kind in _KINDS if kind in used) or ("all",)

    def _counts(self, patients: DataFrame, pieces: DataFrame) -> DataFrame:
        """``by, value, n`` for the pieces asked for."""
        if self._keys is not None:
            return self._keys
        names = patients.select(F.upper("full_name").alias("upper_name"))
        few = few_rows(pieces)
        if few is None:
            held = narrow(names.select(F.explode(name_pieces()).alias("value")), F.col("value"), pieces)
        else:
            held = names.select(F.explode(_held([row.value for row in few])).alias("value"))
        counted = held.groupBy("value").agg(F.count("*").alias("n"))
        return counted.select(F.lit("piece").alias("by"), "value", "n")

    def _with_rarest(self, terms: DataFrame, patients: DataFrame) -> DataFrame:
        """Of very many searches, each pattern takes its rarest piece."""
        asked = terms.filter(F.col("by") == "piece").select("pattern", "pieces").distinct()
        pieces = asked.select("pattern", F.explode("pieces").alias("value"))
        counts = self._counts(patients, pieces.select("value").distinct())
        counts = counts.filter(F.col("by") == "piece").select("value", "n")
        rarest = (
            pieces.join(counts, "value", "left")
            .groupBy("pattern")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "value"))["value"].alias("rarest"))
        )
        joined = terms.join(rarest, "pattern", "left")
        return joined.withColumn("value", F.when(F.col("by") == "piece", F.col("rarest")).otherwise(F.col("value")))

    def _chosen(self, few: list, patients: DataFrame) -> dict[str, tuple[str, str]]:
        """Kind and value of the key of each pattern that has no other than letters of the name."""
        by_name = [row for row in few if row.by == "piece" or self._keys is not None and row.by == "start"]
        pieces = {piece for row in by_name for piece in row.pieces}
        if not by_name:
            return {}
        if len(pieces) == 1 and self._keys is None:
            return {row.pattern: ("piece", *pieces) for row in by_name}
        asked = self._spark.createDataFrame([(piece,) for piece in sorted(pieces)], "value string")
        starts = sorted({row.value for row in by_name if row.by == "start"})
        counts = self._counts(patients, asked)
        wanted = is_one_of(F.col("value"), [*pieces, *starts]) & F.col("by").isin("piece", "start")
        found = {(row.by, row.value): row.n for row in counts.filter(wanted).collect()}
        chosen = {}
        for row in by_name:
            rarest = sorted((found.get(("piece", piece), 0), piece) for piece in row.pieces)
            if row.by == "start" and found.get(("start", row.value), 0) < max(COMMON, rarest[0][0] + 1):
                chosen[row.pattern] = ("start", row.value)
            elif rarest[0][0] >= COMMON and len(rarest) > 1:
                pair = sorted(piece for _, piece in rarest[:2])
                chosen[row.pattern] = ("pair", "".join(pair))
            else:
                chosen[row.pattern] = ("piece", rarest[0][1])
        return chosen

    def _with_chosen(self, terms: DataFrame, chosen: dict[str, tuple[str, str]]) -> DataFrame:
        if not chosen:
            return terms
        rows = [(pattern, by, value) for pattern, (by, value) in chosen.items()]
        table = self._spark.createDataFrame(rows, "pattern string, chosen_by string, chosen string")
        named = F.col("by").isin(*_BY_NAME) & F.col("chosen_by").isNotNull()
        return (
            terms.join(table, "pattern", "left")
            .withColumn("value", F.when(named, F.col("chosen")).otherwise(F.col("value")))
            .withColumn("by", F.when(named, F.col("chosen_by")).otherwise(F.col("by")))
            .drop("chosen", "chosen_by")
        )

    def _narrowed(self, patients: DataFrame, kind: str) -> DataFrame:
        """Few facilities, birth dates or starts of names reach the scan."""
        if self._few is None or kind not in ("facility", "born", "start"):
            return patients
        if kind == "facility":
            return patients.filter(
                is_one_of(F.col("facility_fk"), [row.at_facility for row in self._few])
            )
        if kind == "start":
            return patients.filter(is_one_of(name_start(), self._asked["start"]))
        return patients.filter(is_one_of(F.col("dob"), [row.born for row in self._few]))

    def _value(self, kind: str) -> Column:
        """What a patient is found by; several values are several rows."""
        if kind in ("piece", "pair") and self._asked is not None:
            return F.explode(_held(self._asked[kind]))
        return {
            "facility": F.col("facility_fk").cast("string"),
            "born": F.col("dob").cast("string"),
            "start": name_start(),
            "piece": F.explode(name_pieces()),
            "all": F.pmod(F.xxhash64("patient_pk"), F.lit(self._splits())).cast("string"),
        }[kind]

    def _splits(self) -> int:
        return int(self._spark.conf.get("spark.sql.shuffle.partitions"))

    def _of_kind(self, kind: str) -> DataFrame:
        terms = self.terms.filter(F.col("by") == kind)
        if kind == "all":
            splits = F.sequence(F.lit(0), F.lit(self._splits() - 1)).cast("array<string>")
            return terms.withColumn("value", F.explode(splits))
        return terms

    def matches(self, patients: DataFrame) -> DataFrame:
        """Pairs of search and patient that agree on name, facility and birth date."""
        named = patients.withColumn("upper_name", F.upper("full_name"))
        like = F.when(F.col("plain"), F.startswith("upper_name", "start")).otherwise(
            F.like("upper_name", F.replace("pattern", F.lit("\\"), F.lit("\\\\")))
        )
        agree = (
            (F.col("pattern").isNull() | like)
            & (F.col("at_facility").isNull() | (F.col("facility_fk") == F.col("at_facility")))
            & (F.col("dob_text").isNull() | (F.to_date("dob") == F.col("born")))
        )
        found = [
            self._narrowed(named, kind)
            .withColumn("value", self._value(kind))
            .join(self._of_kind(kind), "value")
            .filter(agree)
            for kind in self.kinds
        ]
        return reduce(DataFrame.unionByName, found)

    def large_groups(self, patients: DataFrame) -> LargeGroups:
        """Searches with very many matches. Stored keys show that a search has fewer rows than that."""
        if self._keys is not None:
            large = F.coalesce("n", F.lit(0)) >= least_large(self._spark)
            asked = self.terms.select("by", "value").distinct()
            held = asked.join(self._keys, ["by", "value"], "left")
            # Without a key, or with two common ones, a search may match very many patients.
            if not held.filter(large | F.col("by").isin("pair", "all")).limit(1).count():
                return LargeGroups(self._spark, "search_id", [])
        sample = sampled(patients, "patient_pk")
        # A patient matches a search once, so a short sample has no search that is seen often.
        if sample.select("patient_pk").limit(SEEN).count() < SEEN:
            return LargeGroups(self._spark, "search_id", [])
        return LargeGroups.of(self.matches(sample), "search_id")


def _with_sort_keys(
    rows: DataFrame, sort_field: str | None, descending: bool
) -> tuple[DataFrame, list[SortKey]]:
    name = F.upper("full_name")
    last_lab = F.col("last_general_lab_date")
    by_field = {
        "fullname": [(name, descending), (last_lab, True)],
        "dateofbirth": [(F.col("dob"), descending), (name, False)],
        "lastdrawdate": [(last_lab, descending), (name, False)],
        "gender": [(F.upper("gender"), descending), (name, False)],
        "modality": [(F.upper("modality"), descending), (name, False)],
        "facilityname": [(F.upper("facility_name"), descending), (name, False)],
        "spectramrn": [(F.col("mrn_number"), descending), (name, False)],
    }
    if sort_field is None:
        # The direction applies to the first name; last names always ascend.
        order = [
            (F.upper("last_name"), False),
            (F.upper("first_name"), descending),
            (last_lab, True),
        ]
    else:
        order = by_field.get(sort_field.lower(), [])
    keys = [SortKey(f"_sort_{i}", down) for i, (_, down) in enumerate(order)]
    columns = {key.column: column for key, (column, _) in zip(keys, order)}
    return rows.withColumns(columns) if columns else rows, [*keys, SortKey("patient_pk")]


def _sites(t: Tables, shown_name: Column) -> DataFrame:
    """Facilities with their client."""
    clients = t["dim_client"].select(
        F.col("client_pk").alias("client_fk"),
        F.col("name").alias("client_name"),
        F.col("corporate_acronym").alias("client_acronym"),
    )
    return (
        t["dim_facility"]
        .select(
            F.col("facility_pk").alias("facility_fk"),
            "facility_id",
            "fmc_number",
            "phone_number",
            shown_name.alias("shown_name"),
            rules.label(F.col("east_west_flag"), rules.FACILITY_CITY).alias("lab"),
            "client_fk",
        )
        .join(clients, "client_fk")
        .drop("client_fk")
    )


def _with_modality_and_physician(t: Tables, rows: DataFrame) -> DataFrame:
    physicians = t["dim_physician"].withColumnRenamed("physician_pk", "physician_fk")
    return (
        rows.join(t["dim_modality"], "modality_code", "left")
        .join(physicians, "physician_fk", "left")
        .withColumn("modality", F.coalesce("modality_description", "modality_code"))
    )


def patient_details(
    t: Tables, mrns: DataFrame | None = None, facility_id: int | None = None
) -> DataFrame:
    """Demographics, facility, client, physician and lab of each patient."""
    numbers = None if mrns is None else mrns.select(F.col("spectra_mrn").cast("string"))
    patients = Scope(numbers).keep(t["dim_patient"], "spectra_mrn")
    if facility_id is not None and facility_id > 0:
        patients = patients.filter(F.col("facility_fk") == facility_id)
    rows = patients.join(_sites(t, F.col("name")), "facility_fk")
    return _with_modality_and_physician(t, rows).select(
        "full_name",
        "dob",
        "gender",
        "modality",
        F.col("spectra_mrn").cast("bigint").alias("spectra_mrn"),
        "external_mrn",
        "client_name",
        "facility_id",
        F.col("shown_name").alias("facility_name"),
        "phone_number",
        "home_phone_number",
        "primary_email",
        "physician_name",
        "lab",
        "facility_fk",
        "patient_type",
    )
