"""The same queries as plain SQL over the star-schema tables, for checking."""

from __future__ import annotations

import re

from lodgeframe.countries import COUNTRY_NAMES
from lodgeframe.fixture import RAW_BOOKINGS_SQL
from lodgeframe.schema import CLEAN_COLUMNS, FACET_COLUMNS, FIELD_KINDS, OUTLIER_COLUMNS, RAW_COLUMNS

_IDS = ["id", *RAW_COLUMNS]
_TABLE = ["id", *CLEAN_COLUMNS]
_DOUBLES = ["children", "agent", "company", "adr"]
_INTS = [c for c, t in RAW_COLUMNS.items() if t == "int"]
_NUMERIC = [c for c, t in RAW_COLUMNS.items() if t in ("int", "double")]
_COUNTRIES = ", ".join(f"('{code}', '{name}')" for code, name in COUNTRY_NAMES.items())

_IMPUTED = """imputed AS (
  SELECT * REPLACE (
    coalesce(children, (SELECT median(children) FROM raw)) AS children,
    coalesce(country, 'Unknown') AS country,
    coalesce(agent, 0) AS agent,
    coalesce(company, 0) AS company)
  FROM raw)"""

_QUANTILES = "quantiles AS (SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.01) AS {c}_p01,"
    f" quantile_cont(CAST({c} AS DOUBLE), 0.99) AS {c}_p99,"
    f" min({c}) AS {c}_min, max({c}) AS {c}_max"
    for c in OUTLIER_COLUMNS
) + " FROM imputed)"

_LIMITS = "limits AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c}_p01 AS p01, {c}_p99 AS p99,
         {c}_p01 - 1.5 * ({c}_p99 - {c}_p01) AS lower_limit,
         {c}_p99 + 1.5 * ({c}_p99 - {c}_p01) AS upper_limit,
         {c}_min AS lo, {c}_max AS hi FROM quantiles"""
    for c in OUTLIER_COLUMNS
) + ")"

_REFERENCE_RULE = """(CASE WHEN hi > upper_limit THEN 1 ELSE 0 END > upper_limit
   OR 0 > upper_limit OR lo < lower_limit)"""
_TWO_SIDED_RULE = "(hi > upper_limit OR lo < lower_limit)"


def _clipped(rule: str) -> str:
    """Clip every outlier column of ``imputed`` that the rule flags."""
    parts = []
    for c in OUTLIER_COLUMNS:
        kind = "DOUBLE" if c in _DOUBLES else "INTEGER"
        pick = f"""(SELECT max({{}}) FROM limits WHERE "column" = '{c}' AND {rule})"""
        up, low = pick.format("upper_limit"), pick.format("lower_limit")
        parts.append(
            f"""CASE WHEN {c} > {up} THEN CAST(round_even({up}, 0) AS {kind})
                     WHEN {c} < {low} THEN CAST(round_even({low}, 0) AS {kind})
                     ELSE {c} END AS {c}"""
        )
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM imputed"


_CLEAN = f"""clipped AS ({_clipped(_REFERENCE_RULE)}),
names(code, name) AS (VALUES {_COUNTRIES}),
clean AS (
  SELECT c.* REPLACE (coalesce(n.name, '') AS country),
    CAST(strptime(arrival_date_year || '-' || arrival_date_month || '-'
      || arrival_date_day_of_month, '%Y-%B-%d') AS DATE) AS arrival_date
  FROM clipped c LEFT JOIN names n ON c.country = n.code)"""


def raw_sql(body: str) -> str:
    return f"WITH RECURSIVE raw AS ({RAW_BOOKINGS_SQL}) {body}"


def imputed_sql(body: str) -> str:
    return raw_sql(f", {_IMPUTED}, {_QUANTILES}, {_LIMITS} {body}")


def clean_sql(body: str) -> str:
    return imputed_sql(f", {_CLEAN} {body}")


def _select(columns, source: str, digits: int = 6, doubles=_DOUBLES) -> str:
    cells = [f"round({c}, {digits}) AS {c}" if c in doubles else c for c in columns]
    return f"SELECT {', '.join(cells)} FROM {source}"


def _unpivot(template: str, columns, source: str) -> str:
    return " UNION ALL ".join(f"SELECT {template.format(c=c)} FROM {source}" for c in columns)


def _top(key: str, size: int = 10, metrics: str = "", name: str | None = None, source="clean", order="doc_count DESC, 1") -> str:
    name = name or key
    return f"""SELECT {key} AS {name}, count(*) AS doc_count{metrics} FROM {source}
               WHERE ({key}) IS NOT NULL GROUP BY 1 ORDER BY {order} LIMIT {size}"""


_NIGHTS = "(stays_in_weekend_nights + stays_in_week_nights)"
_COMPOSITION = (
    "concat(adults, ' adults, ', CAST(children AS DOUBLE), ' children, ', babies, ' babies')"
)
_MONTH = "CAST(date_trunc('month', arrival_date) AS DATE)"
_STAY = f", round(avg({_NIGHTS}), 6) AS average_stay_length"
_LEAD = ", round(avg(lead_time), 6) AS average_lead_time"
_REQUESTS = ", round(avg(total_of_special_requests), 6) AS special_requests_count"
_RATE = ", round(avg(is_canceled), 6) AS cancellation_rate"


def _nested(outer: str, inner: str, metrics: str, names: str, outer_count: str, k1=10, k2=10) -> str:
    return f""", g AS (SELECT {outer} AS o, {inner} AS i, count(*) AS n{metrics} FROM clean GROUP BY 1, 2),
      t AS (SELECT o, CAST(sum(n) AS BIGINT) AS sn FROM g WHERE o IS NOT NULL GROUP BY 1
            ORDER BY sn DESC, o LIMIT {k1}),
      r AS (SELECT g.*, row_number() OVER (PARTITION BY o ORDER BY n DESC, i) AS k FROM g WHERE i IS NOT NULL)
      SELECT t.o AS {outer}, t.sn AS {outer_count}, r.i AS {inner}, r.n AS doc_count{names}
      FROM t LEFT JOIN r ON r.o = t.o AND r.k <= {k2}"""


def _spine(source: str) -> str:
    return f"""CAST(unnest(generate_series((SELECT min(m) FROM {source}),
               (SELECT max(m) FROM {source}), INTERVAL 1 MONTH)) AS DATE) AS m"""


def _months(where: str = "true") -> str:
    return f""", h AS (SELECT {_MONTH} AS m, count(*) AS n FROM clean WHERE {where} GROUP BY 1),
      s AS (SELECT {_spine('h')})"""


_REPORTS = {
    "cancellation_rate": _nested(
        "market_segment", "hotel", _RATE, ", r.cancellation_rate", "segment_doc_count"
    ),
    "adr_by_month": f""", g AS (SELECT {_MONTH} AS m, hotel, count(*) AS n, round(avg(adr), 6) AS average_adr
        FROM clean GROUP BY 1, 2),
      h AS (SELECT m, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1), s AS (SELECT {_spine('h')}),
      r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY n DESC, hotel) AS k FROM g)
      SELECT s.m AS month, coalesce(h.n, 0) AS month_doc_count, r.hotel, r.n AS doc_count, r.average_adr
      FROM s LEFT JOIN h USING (m) LEFT JOIN r ON r.m = s.m AND r.k <= 10""",
    "top_countries": _top("country"),
    "length_of_stay": _top(f"CAST({_NIGHTS} AS VARCHAR)", name="length_of_stay"),
    "booking_trends": f"{_months()} SELECT strftime(s.m, '%Y-%m') AS month, coalesce(n, 0) AS doc_count FROM s LEFT JOIN h USING (m)",
    "special_requests": _top("total_of_special_requests", metrics=_RATE),
    "lead_time_by_status": _top("is_canceled", metrics=_LEAD),
    "room_types": _top("reserved_room_type"),
    "guest_country": _top("country"),
    "booking_source": _top("distribution_channel", 5),
    "revenue": f""", g AS (SELECT reserved_room_type AS o, {_MONTH} AS m, count(*) AS n,
        round(sum(adr * {_NIGHTS}), 4) AS revenue FROM clean GROUP BY 1, 2),
      t AS (SELECT o, CAST(sum(n) AS BIGINT) AS sn FROM g GROUP BY 1 ORDER BY sn DESC, o LIMIT 10)
      SELECT o AS reserved_room_type, sn AS room_doc_count, strftime(m, '%Y-%m') AS month,
        n AS doc_count, revenue FROM t JOIN g USING (o)""",
    "lead_time_adr": """SELECT CAST(floor(lead_time / 10) * 10 AS DOUBLE) AS lead_time_bucket,
        count(*) AS doc_count, round(avg(adr), 6) AS average_adr FROM clean GROUP BY 1""",
    "repeat_guests": """, t AS (SELECT is_repeated_guest AS o, count(*) AS n, round(avg(lead_time), 6) AS l
        FROM clean GROUP BY 1 ORDER BY n DESC, o LIMIT 2),
      u AS (SELECT is_repeated_guest AS o, 'country' AS section, country AS key FROM clean
            UNION ALL SELECT is_repeated_guest, 'hotel', hotel FROM clean),
      g AS (SELECT o, section, key, count(*) AS n FROM u WHERE key IS NOT NULL GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY o, section ORDER BY n DESC, key) AS k FROM g)
      SELECT o AS is_repeated_guest, 'summary' AS section, CAST(NULL AS VARCHAR) AS key, n AS doc_count,
        l AS average_lead_time FROM t
      UNION ALL
      SELECT o, section, key, r.n, NULL FROM r WHERE k <= 10 AND o IN (SELECT o FROM t)""",
    "adr_factors": _top("adr", metrics=_RATE + _STAY + _REQUESTS, order="1"),
    "cancel_factors": _top("is_canceled", 2, _LEAD + _STAY + _REQUESTS),
    "composition": _top(_COMPOSITION, metrics=_LEAD + _STAY + _REQUESTS, name="booking_composition"),
}


#: Columns that tell a report's rows apart; the others are values.
_LABELS = {
    "cancellation_rate": ["market_segment", "hotel"],
    "adr_by_month": ["month", "hotel"],
    "booking_trends": ["month"],
    "revenue": ["reserved_room_type", "month"],
    "repeat_guests": ["is_repeated_guest", "section", "key"],
}
_VALUES = {
    "cancellation_rate": ["segment_doc_count", "doc_count", "cancellation_rate"],
    "adr_by_month": ["month_doc_count", "doc_count", "average_adr"],
    "special_requests": ["doc_count", "cancellation_rate"],
    "lead_time_by_status": ["doc_count", "average_lead_time"],
    "revenue": ["room_doc_count", "doc_count", "revenue"],
    "lead_time_adr": ["doc_count", "average_adr"],
    "repeat_guests": ["doc_count", "average_lead_time"],
    "adr_factors": ["doc_count", "cancellation_rate", "average_stay_length", "special_requests_count"],
    "cancel_factors": ["doc_count", "average_lead_time", "average_stay_length", "special_requests_count"],
    "composition": ["doc_count", "average_lead_time", "average_stay_length", "special_requests_count"],
}
_SINGLE_LABELS = {
    "top_countries": "country",
    "length_of_stay": "length_of_stay",
    "special_requests": "total_of_special_requests",
    "lead_time_by_status": "is_canceled",
    "room_types": "reserved_room_type",
    "guest_country": "country",
    "booking_source": "distribution_channel",
    "lead_time_adr": "lead_time_bucket",
    "adr_factors": "adr",
    "cancel_factors": "is_canceled",
    "composition": "booking_composition",
}


def _report_values(name: str) -> str:
    """A report in long form: a row for each of its values."""
    body = _REPORTS[name].strip()
    inner = f"WITH {body[1:]}" if body.startswith(",") else body
    labels = ", ".join(f"CAST({c} AS VARCHAR)" for c in _LABELS.get(name) or [_SINGLE_LABELS[name]])
    cells = ", ".join(f"{{'metric': '{c}', 'value': CAST({c} AS DOUBLE)}}" for c in _VALUES.get(name, ["doc_count"]))
    told = f"SELECT concat_ws('|', {labels}) AS labels, unnest([{cells}]) AS cell FROM ({_unrounded(inner)})"
    return f"SELECT '{name}' AS report, labels, cell.metric AS metric, round(1e-9 + cell.value, 4) AS value FROM ({told})"


def _unrounded(sql: str) -> str:
    """The same without rounding to six digits; values are rounded once, at the end."""
    return re.sub(r"round\(((?:avg|sum)\((?:[^()]|\([^()]*\))*\)), \d\)", r"\1", sql)


def _report(name: str) -> str:
    """The report as a WITH clause plus a parenthesised query for reuse."""
    body = _REPORTS[name].strip()
    if not body.startswith(","):
        return f", rep AS ({body})"
    depth, cut = 0, 0
    for at, char in enumerate(body):
        depth += {"(": 1, ")": -1}.get(char, 0)
        if depth == 0 and body.startswith("SELECT", at):
            cut = at
            break
    return f"{body[:cut].rstrip()}, rep AS ({body[cut:]})"


def _shaped(name: str, select: str) -> str:
    return clean_sql(f"{_report(name)} {select}")


_STATUS = "CASE is_canceled WHEN 0 THEN 'Not Cancelled' WHEN 1 THEN 'Cancelled' END"
_PIVOT = """SELECT market_segment,
   coalesce(max(CASE WHEN hotel = 'City Hotel' THEN cancellation_rate END), 0) AS c,
   coalesce(max(CASE WHEN hotel = 'Resort Hotel' THEN cancellation_rate END), 0) AS r
   FROM rep GROUP BY 1"""


def _metric_rows(prefix: str, cells: dict[str, str], source: str = "clean") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{prefix}' AS agg, {f"'{k}'" if k else 'CAST(NULL AS VARCHAR)'} AS key,
            CAST(NULL AS BIGINT) AS doc_count, round(CAST({v} AS DOUBLE), 6) AS value FROM {source}"""
        for k, v in cells.items()
    )


_STATS = {
    "count": "count(lead_time)",
    "min": "min(lead_time)",
    "max": "max(lead_time)",
    "avg": "avg(lead_time)",
    "sum": "sum(lead_time)",
}
_EXTENDED = {
    **_STATS,
    "sum_of_squares": "sum(CAST(lead_time AS DOUBLE) * lead_time)",
    "variance": "var_pop(lead_time)",
    "variance_sampling": "var_samp(lead_time)",
    "std_deviation": "stddev_pop(lead_time)",
    "std_deviation_sampling": "stddev_samp(lead_time)",
}
_PERCENTS = [1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0]


def _term_rows(field: str) -> str:
    return f"""SELECT '{field}_terms' AS agg, CAST(k AS VARCHAR) AS key, doc_count, CAST(NULL AS DOUBLE) AS value
      FROM ({_top(field, name='k')})"""


_DYNAMIC = " UNION ALL ".join(
    [
        _metric_rows("adr_avg", {None: "avg(adr)"}),
        _metric_rows("lead_time_sum", {None: "sum(lead_time)"}),
        """SELECT 'arrival_date_max', CAST(max(arrival_date) AS VARCHAR), CAST(NULL AS BIGINT),
           CAST(epoch_ms(CAST(max(arrival_date) AS TIMESTAMP)) AS DOUBLE) FROM clean""",
        _metric_rows("lead_time_stats", _STATS),
        _term_rows("hotel"),
        _term_rows("adults"),
    ]
)

# --- text ---

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def _edit_distance(left: str, right: str) -> str:
    """Edit distance with neighbour swaps over lists of characters, row by row.

    The last two rows are kept end to end in one list.
    """
    return f"""(list_reduce(
      range(1, len({left}) + 1),
      lambda acc, i: list_concat(acc[len({right}) + 2:], list_reduce(
        range(1, len({right}) + 1),
        lambda row, j: list_append(row, least(
          acc[len({right}) + 2 + j] + 1,
          row[j] + 1,
          acc[len({right}) + 1 + j] + CASE WHEN {left}[i] = {right}[j] THEN 0 ELSE 1 END,
          CASE WHEN i > 1 AND j > 1 AND {left}[i] = {right}[j - 1] AND {left}[i - 1] = {right}[j]
               THEN acc[j - 1] + 1 ELSE 1000 END)),
        [i])),
      list_concat(range(0, len({right}) + 1), range(0, len({right}) + 1))))[-1]"""


def _expansions(vocab: str, words) -> str:
    """CTEs: per word (and field) the vocabulary tokens within the allowed edits."""
    values = ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))
    return f"""words(no, word) AS (VALUES {values}),
      pairs AS (
        SELECT v.*, w.no, w.word,
          CASE WHEN length(word) <= 2 THEN 0 WHEN length(word) <= 5 THEN 1 ELSE 2 END AS edits,
          string_split(v.token, '') AS a, string_split(w.word, '') AS b
        FROM {vocab} v JOIN words w
          ON abs(length(v.token) - length(w.word)) <=
             CASE WHEN length(word) <= 2 THEN 0 WHEN length(word) <= 5 THEN 1 ELSE 2 END),
      near AS (SELECT *, {_edit_distance('a', 'b')} AS distance FROM pairs
               WHERE levenshtein(token, word) <= 4 * edits),
      expanded AS (SELECT * FROM near WHERE distance <= edits)"""


def _fulltext(source: str, key: str, fields, words) -> str:
    """CTEs ending in ``matched``: (key, score) of the rows in which every word occurs."""
    occurrences = " UNION ALL ".join(
        f"SELECT {key} AS id, '{f}' AS field, unnest({_TOKENS.format(f)}) AS token FROM {source}"
        for f in fields
    )
    return f"""occ AS ({occurrences}),
      tf AS (SELECT id, field, token, count(*) AS tf FROM occ GROUP BY ALL),
      dl AS (SELECT id, field, count(*) AS dl FROM occ GROUP BY ALL),
      n AS ({' UNION ALL '.join(f"SELECT '{f}' AS field, count({f}) AS n FROM {source}" for f in fields)}),
      avgdl AS (SELECT n.field, n.n, sum(dl.dl) / n.n AS avgdl FROM n JOIN dl ON n.field = dl.field GROUP BY n.field, n.n),
      vocab AS (SELECT field, token, count(*) AS doc_freq FROM tf GROUP BY ALL),
      {_expansions('vocab', words)},
      part AS (
        SELECT tf.id, e.no, tf.field, sum(
          2.2 * (1 - e.distance / least(length(e.token), length(e.word)))
          * ln(1 + (g.n - e.doc_freq + 0.5) / (e.doc_freq + 0.5))
          * tf.tf / (tf.tf + 1.2 * (0.25 + 0.75 * dl.dl / g.avgdl))) AS s
        FROM tf JOIN expanded e USING (field, token) JOIN dl ON dl.id = tf.id AND dl.field = tf.field
          JOIN avgdl g ON g.field = tf.field
        GROUP BY ALL),
      best AS (SELECT id, no, max(s) AS s FROM part GROUP BY ALL),
      matched AS (SELECT id, sum(s) AS score FROM best GROUP BY id HAVING count(*) = {len(words)})"""


_HIT_COLUMNS = "id, hotel, country, adults, lead_time, round(adr, 6) AS adr"
_MEAL_OR_ADULTS = "(lower(meal) = 'bb' OR adults = 3)"
_SEARCH_WHERE = f"""country NOT IN ('United Kingdom', 'United States', 'United Arab Emirates')
   AND hotel IS NOT NULL AND {_MEAL_OR_ADULTS} AND lead_time >= 10 AND lead_time < 300"""


def _overlap(field: str, words: str) -> str:
    return f"list_has_any({_TOKENS.format(field)}, [{words}])"


def _hits(where: str, tail: str = "") -> str:
    return clean_sql(f"SELECT {_HIT_COLUMNS} FROM clean WHERE {where} {tail}")


def _idf(n: str, df: str) -> str:
    return f"ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5))"


def _build() -> dict[str, str]:
    sql: dict[str, str] = {}
    # sources and sinks
    sql["scan_bookings_csv"] = raw_sql(f"SELECT {', '.join(_IDS)} FROM raw")
    table = clean_sql(f"SELECT {', '.join(_TABLE)} FROM clean")
    for name in ("scan_clean_csv", "scan_bookings_table", "bulk_insert"):
        sql[name] = table
    sql["scan_quoted_lines"] = clean_sql(
        f"""SELECT {', '.join(_TABLE)} FROM
            (SELECT * REPLACE (hotel || ',' || chr(10) || '"' || meal || '"' || chr(10) || country AS hotel) FROM clean)"""
    )
    torn, wrong = "id % 89 = 7", "id % 97 = 5"
    sql["quarantine_good_rows"] = raw_sql(f"SELECT {', '.join(_IDS)} FROM raw WHERE NOT ({torn} OR {wrong})")
    sql["quarantine_rejects"] = raw_sql(
        f"""SELECT id, CASE WHEN {torn} THEN 'torn' ELSE 'type' END AS reason,
              CASE WHEN {torn} THEN '' ELSE 'lead_time' END AS bad_columns, true AS placed
            FROM raw WHERE {torn} OR {wrong}"""
    )
    sql["sync_snapshot"] = clean_sql(
        f""", u AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN adr ELSE adr + 1 END AS adr,
              CASE WHEN id % 3 = 0 THEN hotel ELSE hotel || ' *' END AS hotel) FROM clean) {_select(_TABLE, 'u')}"""
    )
    sql["scan_latest_file"] = clean_sql(
        f"SELECT {', '.join(_TABLE)} FROM (SELECT * REPLACE (hotel || ' 2' AS hotel) FROM clean)"
    )
    sql["sync_changed_buckets"] = clean_sql(f"SELECT *, true AS as_expected FROM ({_select(_TABLE, 'clean')})")
    cells = ("id", "hotel", "country", "lead_time", "market_segment", "adr", "arrival_date", "reservation_status_date")
    sql["sink_clean_csv"] = clean_sql(f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in cells)} FROM clean")
    rows = _select(CLEAN_COLUMNS, "clean")
    sql["append_bookings"] = clean_sql(
        f""", twice AS ({rows} UNION ALL {rows})
        SELECT *, count(*) OVER () AS n_rows, count(*) OVER () AS n_ids, CAST(1 AS BIGINT) AS min_id,
          count(*) OVER () AS max_id FROM twice"""
    )
    sql["bootstrap_if_empty"] = clean_sql(rows)
    sql["to_documents"] = clean_sql(
        """SELECT id, hotel, country, reservation_status, hotel AS hotel_suggest_input,
           country AS country_suggest_input, reservation_status AS reservation_status_suggest_input
           FROM clean"""
    )
    sql["upsert_by_id"] = clean_sql(
        """, u AS (SELECT CASE WHEN id % 2 = 0 THEN id ELSE id + 1000000000 END AS id, hotel || ' *' AS hotel,
             CASE WHEN id % 4 = 0 THEN NULL ELSE adr + 1 END AS adr, lead_time FROM clean WHERE id % 3 = 0)
        SELECT id, hotel, round(adr, 6) AS adr, lead_time, country, is_canceled FROM clean
        WHERE id NOT IN (SELECT id FROM u)
        UNION ALL
        SELECT u.id, u.hotel, round(u.adr, 6), u.lead_time, c.country, c.is_canceled
        FROM u LEFT JOIN clean c ON c.id = u.id"""
    )
    kinds = {"id": "bigint", **CLEAN_COLUMNS}
    sql["field_catalogue"] = clean_sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", '{t}' AS dtype, '{FIELD_KINDS[c]}' AS kind,
                count({c}) AS non_nulls FROM clean"""
            for c, t in kinds.items()
        )
    )
    sql["sink_search_json"] = clean_sql(
        f"""SELECT {', '.join(CLEAN_COLUMNS)} FROM
            (SELECT * FROM clean WHERE is_canceled = 1)"""
    )
    sql["run_etl"] = clean_sql(f"SELECT {', '.join(CLEAN_COLUMNS)} FROM clean")

    # cleaning
    sql["null_counts"] = raw_sql(
        _unpivot("""'{c}' AS "column", count(*) - count({c}) AS nulls""", _IDS, "raw")
    )
    sql["fill_median"] = imputed_sql("SELECT id, children FROM imputed")
    sql["fill_constant"] = imputed_sql("SELECT id, country, agent, company FROM imputed")
    sql["assert_no_nulls"] = imputed_sql(
        "SELECT CAST(" + " + ".join(f"(count(*) - count({c}))" for c in _IDS) + " AS BIGINT) AS total_nulls, count(*) AS gated_rows FROM imputed"
    )
    sql["outlier_thresholds"] = imputed_sql(
        """SELECT "column", round(p01, 6) AS p01, round(p99, 6) AS p99,
           round(lower_limit, 6) AS lower_limit, round(upper_limit, 6) AS upper_limit FROM limits"""
    )
    sql["detect_outliers"] = imputed_sql(
        " UNION ALL ".join(
            f"""SELECT "column", round(lower_limit, 6) AS lower_limit, round(upper_limit, 6) AS upper_limit,
                {rule} AS has_outliers, '{name}' AS rule FROM limits"""
            for name, rule in (("reference", _REFERENCE_RULE), ("two_sided", _TWO_SIDED_RULE))
        )
    )
    for name, rule in (
        ("suppress_outliers", _REFERENCE_RULE),
        ("suppress_outliers_two_sided", _TWO_SIDED_RULE),
    ):
        sql[name] = imputed_sql(
            f", x AS ({_clipped(rule)}) " + _select(["id", *OUTLIER_COLUMNS], "x")
        )
    sql["map_country"] = clean_sql("SELECT id, country FROM clean")
    sql["build_arrival_date"] = clean_sql("SELECT id, arrival_date FROM clean")
    sql["clean_bookings"] = clean_sql(_select(_TABLE, "clean"))
    sql["stream_upload_sync"] = sql["clean_bookings"]
    sql["stream_late_file"] = clean_sql(
        """SELECT id, CAST(lead_time + CASE WHEN id % 3 = 0 THEN 2 WHEN id % 2 = 0 THEN 1 ELSE 1000 END AS INTEGER) AS lead_time,
           hotel, arrival_date FROM clean"""
    )
    places = ", ".join(f"('{c}', {p}, true)" for c in ("lead_time", "adr", "agent") for p in (0.01, 0.25, 0.5, 0.75, 0.99))
    sql["sketched_percentiles"] = f"""SELECT "column", CAST(p AS DOUBLE) AS p, within FROM (VALUES {places}) t("column", p, within)"""
    sql["sketched_distinct"] = raw_sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique, true AS within FROM raw WHERE id % 4 <> 1"""
            for c in _IDS
        )
    )
    sql["strict_cast"] = sql["scan_bookings_csv"]
    sql["strict_cast_rejects"] = raw_sql(
        """SELECT id, concat_ws(',', CASE WHEN id % 97 = 5 THEN 'lead_time' END,
             CASE WHEN id % 89 = 7 THEN 'adr' END) AS bad_columns
           FROM raw WHERE id % 97 = 5 OR id % 89 = 7"""
    )

    # profiling
    sql["profile_shape"] = clean_sql(
        f"SELECT count(*) AS n_rows, CAST({len(_TABLE)} AS BIGINT) AS n_columns FROM clean"
    )
    sql["head"] = clean_sql(_select(_TABLE, "clean") + " ORDER BY id LIMIT 5")
    sql["profile_columns"] = raw_sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS nulls,
                count({c}) AS non_nulls FROM raw"""
            for c, t in {"id": "bigint", **RAW_COLUMNS}.items()
        )
    )
    described = {
        "count": "count({c})",
        "mean": "avg({c})",
        "std": "stddev_samp({c})",
        "min": "min({c})",
        "25%": "quantile_cont(CAST({c} AS DOUBLE), 0.25)",
        "50%": "quantile_cont(CAST({c} AS DOUBLE), 0.5)",
        "75%": "quantile_cont(CAST({c} AS DOUBLE), 0.75)",
        "max": "max({c})",
    }
    sql["describe"] = clean_sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", '{stat}' AS stat,
                round(CAST({text.format(c=c)} AS DOUBLE), 6) AS value FROM clean"""
            for c in _NUMERIC
            for stat, text in described.items()
        )
    )
    kind = {c: "number" if t in ("int", "double") else "date" if t == "date" else "other" for c, t in RAW_COLUMNS.items()}
    uniques = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kind[c]}' AS kind, count(DISTINCT {c}) AS n_unique,
            count(*) AS n_rows FROM imputed"""
        for c in RAW_COLUMNS
    )
    sql["classify_columns"] = imputed_sql(
        f""", u AS ({uniques}),
        q AS (SELECT quantile_cont(CAST(n_unique AS DOUBLE), 0.1) AS lo,
                     quantile_cont(CAST(n_unique AS DOUBLE), 0.9) AS hi FROM u)
        SELECT "column", CASE WHEN kind = 'number' AND n_unique < lo THEN 'num_but_cat'
          WHEN kind = 'number' THEN 'numerical' WHEN kind = 'date' THEN 'date'
          WHEN n_unique > hi OR n_unique > n_rows * 0.2 THEN 'high_cardinality'
          ELSE 'categorical' END AS class, n_unique FROM u, q"""
    )
    sql["correlation_matrix"] = clean_sql(
        " UNION ALL ".join(
            f"""SELECT '{a}' AS col_a, '{b}' AS col_b,
                CASE WHEN min({a}) = max({a}) OR min({b}) = max({b}) THEN CAST('NaN' AS DOUBLE)
                     ELSE round(corr({a}, {b}), 6) END AS r FROM clean"""
            for a in _NUMERIC
            for b in _NUMERIC
        )
    )
    sql["value_counts_filtered"] = clean_sql(
        "SELECT country, count(*) AS doc_count FROM clean WHERE country = 'Unknown' GROUP BY 1"
    )
    sql["distinct_values"] = clean_sql(
        " UNION ".join(
            f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM clean" for c in FACET_COLUMNS
        )
    )
    sql["date_bounds"] = clean_sql(
        "SELECT min(arrival_date) AS min_date, max(arrival_date) AS max_date FROM clean"
    )

    # structured search
    sql["match_exact"] = _hits("adults = 2")
    sql["match_text"] = _hits(_overlap("country", "'united', 'kingdom'"))
    sql["filter_must"] = _hits("hotel LIKE 'Resort%' AND is_canceled = 1")
    united = _overlap("country", "'united', 'kingdom'")
    sql["filter_must_not"] = _hits(f"NOT coalesce({united}, false) AND NOT adults = 2")
    sql["filter_should"] = _hits("country = 'Portugal' OR adults = 55 OR meal = 'SC'")
    sql["filter_range"] = _hits(
        """lead_time >= 100 AND lead_time < 200
           AND arrival_date > DATE '1997-06-30' AND arrival_date <= DATE '1998-06-30'"""
    )
    searched = (
        f"NOT coalesce({united}, false) AND {_overlap('hotel', chr(39) + 'city' + chr(39) + ', ' + chr(39) + 'hotel' + chr(39))}"
        f" AND {_MEAL_OR_ADULTS} AND lead_time >= 10 AND lead_time < 300"
    )
    sql["search"] = _hits(searched)
    sql["search_all"] = _hits("true")
    sql["search_total"] = clean_sql(
        "SELECT count(*) AS total FROM clean WHERE hotel LIKE '%Hotel'"
    )
    tok = {f: _TOKENS.format(f) for f in ("hotel", "meal")}
    words = {"hotel": ["city", "hotel"], "meal": ["bb"]}
    stats = ", ".join(
        f"count({f}) AS n_{f}, sum(len({tok[f]})) / count({f}) AS avg_{f}, "
        + ", ".join(f"count(*) FILTER (list_contains({tok[f]}, '{w}')) AS df_{w}" for w in ws)
        for f, ws in words.items()
    )
    def relevance(f: str, w: str) -> str:
        return f"""2.2 * {_idf(f'n_{f}', f'df_{w}')} * len(list_filter({tok[f]}, lambda x: x = '{w}'))
            / (len(list_filter({tok[f]}, lambda x: x = '{w}')) + 1.2 * (0.25 + 0.75 * len({tok[f]}) / avg_{f}))"""

    score = " + ".join(relevance(f, w) for f, ws in words.items() for w in ws)
    sql["search_score"] = clean_sql(
        f""", st AS (SELECT {stats} FROM clean),
        sc AS (SELECT clean.*, 1.0 + CASE WHEN adults = 3 THEN 1 ELSE 0 END + {score} AS score FROM clean, st)
        SELECT id, round(CAST(score AS DOUBLE), 5) AS score FROM sc WHERE {searched}"""
    )
    clauses = " + ".join(relevance("hotel", w) for w in ("city", "hotel", "city"))
    sql["search_score_clauses"] = clean_sql(
        f""", st AS (SELECT {stats} FROM clean),
        sc AS (SELECT clean.*, CASE WHEN adults = 3 THEN 1 ELSE 0 END + {clauses} AS score FROM clean, st)
        SELECT id, round(CAST(score AS DOUBLE), 5) AS score FROM sc WHERE hotel IS NOT NULL
          AND (adults = 3 OR list_contains({tok['hotel']}, 'city'))"""
    )
    sql["project_hits"] = clean_sql(
        f", x AS (SELECT * FROM clean WHERE adults = 3) {_select(CLEAN_COLUMNS, 'x')}"
    )
    sql["search_arrival_day"] = _hits(
        "arrival_date = (SELECT min(arrival_date) FROM clean)"
    )

    # aggregations
    sql["terms"] = clean_sql(_top("country"))
    sql["terms_envelope"] = clean_sql(
        f""", t AS ({_top('country')}), a AS (SELECT count(country) AS n FROM clean),
        s AS (SELECT CAST(sum(doc_count) AS BIGINT) AS k FROM t)
        SELECT n AS total_doc_count, k AS returned_doc_count, n - k AS sum_other_doc_count FROM a, s"""
    )
    for kind, (field, text) in {
        "avg": ("adr", "avg(adr)"),
        "sum": ("adr", "sum(adr)"),
        "min": ("adr", "min(adr)"),
        "max": ("lead_time", "max(lead_time)"),
        "value_count": ("country", "count(country)"),
        "cardinality": ("country", "count(DISTINCT country)"),
    }.items():
        sql[f"metric_{kind}"] = clean_sql(_metric_rows(f"{field}_{kind}", {None: text}))
    sql["metric_stats"] = clean_sql(_metric_rows("lead_time_stats", _STATS))
    sql["metric_extended_stats"] = clean_sql(_metric_rows("lead_time_extended_stats", _EXTENDED))
    sql["metric_percentiles"] = clean_sql(
        _metric_rows("adr_percentiles", {str(p): f"quantile_cont(adr, {p / 100})" for p in _PERCENTS})
    )
    sql["metric_missing"] = raw_sql(
        _metric_rows("company_missing", {None: "count(*) - count(company)"}, "raw")
    )
    sql["metric_mad"] = clean_sql(
        _metric_rows("adr_median_absolute_deviation", {None: "mad(adr)"})
    )
    sql["dynamic_aggregate"] = clean_sql(_DYNAMIC)
    sql["composite"] = clean_sql(
        """SELECT hotel, country, count(*) AS doc_count FROM clean
           WHERE (hotel, country) > ('City Hotel', 'Brazil') GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 10"""
    )
    sql["significant_terms"] = clean_sql(
        """, g AS (SELECT country, count(*) FILTER (hotel = 'Resort Hotel') AS f, count(*) AS b FROM clean GROUP BY 1),
        s AS (SELECT country, f, b, f / sum(f) OVER () AS fs, b / sum(b) OVER () AS bs FROM g)
        SELECT country, f AS doc_count, b AS bg_count, round((fs - bs) * (fs / bs), 6) AS score
        FROM s WHERE f >= 3 AND fs > bs ORDER BY (fs - bs) * (fs / bs) DESC, country LIMIT 10"""
    )
    sql["nested_terms"] = clean_sql(
        _nested("country", "meal", ", round(avg(adr), 6) AS average_adr", ", r.average_adr", "country_doc_count", 5, 2)
    )
    sql["date_histogram"] = clean_sql(
        f"{_months()} SELECT s.m AS month, coalesce(n, 0) AS doc_count FROM s LEFT JOIN h USING (m)"
    )
    sql["date_histogram_nofill"] = clean_sql(
        f"SELECT {_MONTH} AS month, count(*) AS doc_count FROM clean GROUP BY 1"
    )
    sql["histogram"] = clean_sql(
        """SELECT CAST(floor(lead_time / 10) * 10 AS DOUBLE) AS bucket, count(*) AS doc_count,
           round(avg(adr), 6) AS average_adr FROM clean GROUP BY 1"""
    )
    sql["terms_scripted_num"] = clean_sql(_top(f"CAST({_NIGHTS} AS VARCHAR)", name="nights"))
    sql["terms_scripted_str"] = clean_sql(_top(_COMPOSITION, name="composition"))
    sql["sum_scripted"] = clean_sql(f"SELECT round(sum(adr * {_NIGHTS}), 4) AS revenue FROM clean")
    sql["avg_scripted"] = clean_sql(f"SELECT round(avg({_NIGHTS}), 6) AS average_stay FROM clean")
    sql["terms_by_key"] = clean_sql(_top("adr", order="1"))
    sql["sub_aggs_multi"] = clean_sql(
        _top(
            "meal",
            metrics=""", round(avg(adr), 6) AS average_adr, max(lead_time) AS max_lead_time,
               CAST(sum(is_canceled) AS BIGINT) AS canceled""",
        )
    )

    # reports
    for name, body in _REPORTS.items():
        sql[f"report_{name}"] = clean_sql(body)
    values = " UNION ALL ".join(_report_values(name) for name in _REPORTS)
    sql["all_reports"] = clean_sql(values)
    some = "id % 3 = 1 AND id % 2 = 0 AND id % 5 <> 0"
    sql["reports_after_updates"] = clean_sql(
        f""", before AS (SELECT * FROM clean), changed AS (SELECT * REPLACE (
              CASE WHEN {some} THEN adr + 10 ELSE adr END AS adr, CASE WHEN {some} THEN 'City Hotel' ELSE hotel END AS hotel,
              CASE WHEN {some} THEN 1 - is_canceled ELSE is_canceled END AS is_canceled) FROM before)
        SELECT * FROM (WITH clean AS (SELECT * FROM changed) {values})"""
    )

    # display shapes
    sql["pivot_cancellation_rate"] = _shaped(
        "cancellation_rate",
        f"""SELECT market_segment AS "Market Segment", c AS "City Hotel Cancellation Rate",
            r AS "Resort Hotel Cancellation Rate" FROM ({_PIVOT})""",
    )
    sql["mean_of_segment_rates"] = _shaped(
        "cancellation_rate",
        f""", p AS ({_PIVOT})
        SELECT 'City Hotel' AS "Hotel Type", round(avg(c), 6) AS "Average Cancellation Rate" FROM p
        UNION ALL SELECT 'Resort Hotel', round(avg(r), 6) FROM p""",
    ).replace("round(avg(is_canceled), 6)", "avg(is_canceled)")
    sql["pivot_adr_by_month"] = _shaped(
        "adr_by_month",
        """SELECT strftime(month, '%Y-%m') AS "Month",
           max(CASE WHEN hotel = 'City Hotel' THEN average_adr END) AS "City Hotel ADR",
           max(CASE WHEN hotel = 'Resort Hotel' THEN average_adr END) AS "Resort Hotel ADR"
           FROM rep GROUP BY 1""",
    )
    sql["shape_length_of_stay"] = _shaped(
        "length_of_stay",
        """SELECT CAST(length_of_stay AS INTEGER) AS "Length of Stay", doc_count AS "Counts" FROM rep""",
    )
    sql["shape_lead_time_status"] = _shaped(
        "lead_time_by_status",
        f"""SELECT {_STATUS} AS "Cancellation Status", average_lead_time AS "Average Lead Time" FROM rep""",
    )
    sql["trend_peaks"] = _shaped(
        "booking_trends",
        """SELECT month AS "Date", doc_count,
           doc_count = (SELECT max(doc_count) FROM rep) AS is_peak FROM rep""",
    )
    sql["flatten_revenue"] = _shaped(
        "revenue",
        """SELECT reserved_room_type AS "Room Type", month AS "Month", revenue AS "Revenue",
           format('{:,.2f}', revenue) AS "Revenue Text" FROM rep""",
    )
    sql["shape_composition"] = _shaped(
        "composition",
        """SELECT replace(booking_composition, '.0', '') AS "Booking Composition",
           doc_count AS "Number of Bookings" FROM rep""",
    )
    sql["shape_cancel_factors"] = _shaped(
        "cancel_factors",
        f"""SELECT {_STATUS} AS "Cancellation Status", special_requests_count AS "Special Requests Count",
            average_stay_length AS "Average Stay Length", average_lead_time AS "Average Lead Time" FROM rep""",
    )
    sql["shape_repeat_guests"] = _shaped(
        "repeat_guests",
        """SELECT CASE is_repeated_guest WHEN 1 THEN 'Repeat Guests' ELSE 'First-time Guests' END || ' - ' || key
           AS "Guest Type", doc_count AS "Number of Bookings" FROM rep WHERE section = 'hotel'""",
    )
    sql["adr_factor_matrix"] = _shaped(
        "adr_factors",
        """SELECT adr, 'Special Requests Count' AS factor, special_requests_count AS value FROM rep
           UNION ALL SELECT adr, 'Cancellation Rate', cancellation_rate FROM rep
           UNION ALL SELECT adr, 'Average Stay Length', average_stay_length FROM rep""",
    )
    renames = {
        "top_countries": ("country", "Country", "doc_count", "Booking Counts"),
        "special_requests": ("total_of_special_requests", "Special Requests", "doc_count", "Counts"),
        "room_types": ("reserved_room_type", "Room Type", "doc_count", "Bookings"),
        "guest_country": ("country", "Country", "doc_count", "Bookings"),
        "booking_source": ("distribution_channel", "Source", "doc_count", "Bookings"),
        "lead_time_adr": ("lead_time_bucket", "Lead Time", "average_adr", "Average ADR"),
    }
    sql["shape_renames"] = clean_sql(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS report, '{kl}' AS key_label, CAST({k} AS VARCHAR) AS key,
                '{vl}' AS value_label, CAST({v} AS DOUBLE) AS value FROM ({_REPORTS[name]})"""
            for name, (k, kl, v, vl) in renames.items()
        )
    )
    sql["shape_dynamic_aggregate"] = clean_sql(
        f""", d AS ({_DYNAMIC})
        SELECT CASE WHEN doc_count IS NULL THEN regexp_replace(agg, '^(.*)_([a-z]+)$', '\\1 (\\2)') ELSE agg END AS label,
          key, coalesce(CAST(doc_count AS DOUBLE), value) AS value
        FROM d"""
    )

    sql["group_revenue_series"] = _shaped(
        "revenue",
        """SELECT reserved_room_type AS "Room Type",
           CAST(to_json(list({'month': month, 'revenue': revenue} ORDER BY month)) AS VARCHAR) AS series
           FROM rep GROUP BY 1""",
    )
    sql["report_payload"] = _shaped(
        "room_types",
        """SELECT 'room_types' AS report, CAST(to_json(list({'Room Type': reserved_room_type,
           'Bookings': doc_count} ORDER BY reserved_room_type)) AS VARCHAR) AS payload FROM rep""",
    )

    # text
    toks = _TOKENS.format("text")
    sql["tokenize"] = f"""SELECT doc_id, len({toks}) AS n_tokens, len(list_distinct({toks})) AS n_distinct,
        array_to_string({toks}, ' ') AS joined FROM documents"""
    fuzzy = ["of", "there", "worthless", "eauxment"]
    sql["fuzzy_terms"] = f"""WITH vocab AS (SELECT 'text' AS field, token, count(DISTINCT doc_id) AS doc_freq
        FROM (SELECT doc_id, unnest({toks}) AS token FROM documents) GROUP BY ALL),
        {_expansions('vocab', fuzzy)}
        SELECT word, token, distance, doc_freq FROM expanded"""
    found = f"WITH {_fulltext('documents', 'doc_id', ['text'], ['worthles', 'there'])}"
    sql["full_text_search"] = f"{found} SELECT id AS doc_id FROM matched"
    sql["full_text_score"] = (
        f"{found} SELECT id AS doc_id, round(CAST(score AS DOUBLE), 4) AS score FROM matched"
        " ORDER BY matched.score DESC, id LIMIT 10"
    )
    scores = "SELECT id AS doc_id, round(CAST(score AS DOUBLE), 4) AS score FROM matched"
    sql["full_text_indexed"] = f"{found} {scores}"
    sql["full_text_index_updated"] = f"""WITH changed AS (
          SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' worthless there' ELSE text END AS text
          FROM documents WHERE doc_id % 7 <> 0),
        {_fulltext('changed', 'doc_id', ['text'], ['worthles', 'there'])} {scores}"""
    sql["full_text_total"] = (
        f"{found} SELECT count(*) AS total FROM matched"
    )
    sql["full_text_bookings"] = clean_sql(
        f""", {_fulltext('clean', 'id', ['country', 'hotel'], ['unitd', 'cty'])}
        SELECT id, country, hotel FROM clean WHERE id IN (SELECT id FROM matched)"""
    )
    sql["suggest"] = clean_sql(
        "SELECT DISTINCT country AS text FROM clean WHERE lower(country) LIKE 's%' ORDER BY 1 LIMIT 5"
    )
    sql["clean_markdown"] = """SELECT conv_id, turn,
        replace(replace(replace(replace(text, '```markdown', ''), '```', ''), '#', '##'), '##', '###') AS text
        FROM conversations"""
    return sql


def _nudged(sql: str) -> str:
    """Round computed values with the same nudge as the queries do (see ``rounded``)."""
    for start in ("avg(", "sum(", "CAST(", "corr(", "(fs "):
        sql = sql.replace(f"round({start}", f"round(1e-9 + {start}")
    return sql


ORACLE: dict[str, str] = {name: _nudged(sql) for name, sql in _build().items()}
