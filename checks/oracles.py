"""DuckDB SQL for the registered queries, written apart from the Spark side."""

from __future__ import annotations

CITATION = """
line AS (
  SELECT *, l_orderkey*31 + l_partkey*7 + l_suppkey*3 + l_linenumber AS k,
         least(l_partkey % 50, l_suppkey % 50) AS vc
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
),
citation AS (
  SELECT
    concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR,
              CAST(l_quantity AS INT)::VARCHAR, CAST(round(l_extendedprice*100) AS BIGINT)::VARCHAR) AS summons_number,
    'lineitem' AS source_dataset,
    CASE WHEN k%97<>0 THEN CAST(l_shipdate AS DATE) END AS issue_date,
    CASE WHEN k%23=0 THEN NULL
         WHEN k%29=0 THEN ' ' || lpad((1+k%12)::VARCHAR,2,'0') || '32a'
         WHEN k%31=0 THEN '1332P'
         WHEN k%37=0 THEN '1432'
         WHEN k%41=0 THEN 'abc'
         WHEN k%89=0 THEN '0032P'
         ELSE lpad((1+k%12)::VARCHAR,2,'0') || lpad((k%60)::VARCHAR,2,'0') || CASE WHEN k%5<2 THEN 'A' ELSE 'P' END
    END AS violation_time,
    CASE WHEN k%101=0 THEN NULL WHEN k%9973=0 THEN '99' ELSE vc::VARCHAR END AS violation_code,
    CASE WHEN k%53<>0 THEN 'CODE ' || vc::VARCHAR END AS violation_desc,
    CASE WHEN k%43<>0 THEN split_part('P, t ,S,V,p', ',', CAST(1+k%5 AS INT)) END AS issuing_agency,
    CASE WHEN k%67<>0 THEN split_part('NY,MN,K,BK,Q,qn ,BX,R,ST,XX', ',', CAST(1+l_suppkey%10 AS INT)) END AS county,
    CASE WHEN k%47<>0 THEN (l_suppkey%77 + 1)::VARCHAR END AS precinct,
    CASE WHEN k%59=0 THEN NULL WHEN k%61=0 THEN '   '
         ELSE 'W ' || (l_suppkey%13)::VARCHAR
              || split_part(' AVE, St,  AVENUE , STREET, BROADWAY, RD, STATE', ',', CAST(1+l_partkey%7 AS INT))
    END AS street_name,
    p_brand AS intersecting_street,
    CASE WHEN k%7<>0 THEN CAST(40.5002 AS DOUBLE) + (l_partkey%50)*CAST(0.001 AS DOUBLE) END AS latitude,
    CASE WHEN k%7<>0 THEN CAST(-74.2002 AS DOUBLE) + (l_suppkey%50)*CAST(0.001 AS DOUBLE) END AS longitude,
    CASE WHEN k%19<>0 THEN CAST(35 + (vc%9)*10 + k%4 AS DECIMAL(10,2)) END AS fine_amount,
    'P' || l_orderkey::VARCHAR AS plate_id,
    split_part('NY,NJ,PA,CT', ',', CAST(1+k%4 AS INT)) AS registration_state,
    CASE WHEN k%71<>0 THEN split_part('PAS,COM,omt ,OMS,SRF,MED,PHS,APP', ',', CAST(1+k%8 AS INT)) END AS plate_type,
    'row-' || k::VARCHAR AS soda_row_id,
    o_orderdate AS soda_created_at, l_shipdate AS soda_updated_at, l_shipdate AS ingested_at,
    k, vc
  FROM line
)"""

FINE = "CAST(SUM(fine_amount) AS DOUBLE) / NULLIF(COUNT(fine_amount), 0)"
STRICT = """CASE WHEN regexp_full_match(violation_time, '[0-9]{4}[AP]') THEN
  CASE WHEN violation_time[1:2] = '12' THEN 0 ELSE CAST(violation_time[1:2] AS INT) END
  + CASE WHEN violation_time[5:5] = 'P' THEN 12 ELSE 0 END END"""
DOW = "CAST(extract(dow FROM issue_date) AS INT)"

FEATURES = r"""
cleaned AS (
  SELECT *,
    upper(regexp_replace(violation_time, '^\s+|\s+$', '', 'g')) AS t,
    upper(regexp_replace(county, '^\s+|\s+$', '', 'g')) AS county_code,
    upper(regexp_replace(street_name, '^\s+|\s+$', '', 'g')) AS street_name_clean,
    upper(regexp_replace(plate_type, '^\s+|\s+$', '', 'g')) AS plate_type_clean,
    coalesce(upper(regexp_replace(issuing_agency, '^\s+|\s+$', '', 'g')), 'UNKNOWN') AS agency
  FROM citation
),
timed AS (
  SELECT *,
    CASE WHEN length(t) >= 4 THEN
      CASE WHEN t LIKE '%P' AND TRY_CAST(t[1:2] AS INT) <> 12 THEN TRY_CAST(t[1:2] AS INT) + 12
           WHEN t LIKE '%A' AND TRY_CAST(t[1:2] AS INT) = 12 THEN 0
           ELSE TRY_CAST(t[1:2] AS INT) END
    END AS raw_hour
  FROM cleaned
),
hours AS (SELECT *, CASE WHEN raw_hour BETWEEN 0 AND 23 THEN raw_hour END AS lenient FROM timed),
feature AS (
  SELECT summons_number, violation_code, issue_date, latitude, longitude,
    CAST(year(issue_date) AS INT) AS year, CAST(month(issue_date) AS INT) AS month,
    CAST(isodow(issue_date) - 1 AS INT) AS day_of_week,
    CAST(day(issue_date) AS INT) AS day_of_month, CAST(weekofyear(issue_date) AS INT) AS week_of_year,
    CASE WHEN isodow(issue_date) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend,
    lenient AS hour,
    CASE WHEN lenient <= 6 THEN 'night' WHEN lenient <= 12 THEN 'morning' WHEN lenient <= 17 THEN 'afternoon'
         WHEN lenient <= 21 THEN 'evening' WHEN lenient <= 24 THEN 'late_night' END AS time_of_day,
    CASE WHEN isodow(issue_date) <= 5 AND lenient IN (7, 8, 9, 16, 17, 18, 19) THEN 1 ELSE 0 END AS is_rush_hour,
    CASE WHEN isodow(issue_date) IN (1, 2, 4, 5) THEN 1 ELSE 0 END AS is_asp_day,
    CASE WHEN county_code IN ('NY','MAN','MH','MN','NEWY','NEW Y') THEN 'Manhattan'
         WHEN county_code IN ('K','BK','KINGS') THEN 'Brooklyn'
         WHEN county_code IN ('Q','QN','QNS','QUEEN') THEN 'Queens'
         WHEN county_code IN ('BX','BRONX') THEN 'Bronx'
         WHEN county_code IN ('R','ST','RICH') THEN 'Staten Island' ELSE 'Unknown' END AS borough,
    regexp_replace(precinct, '^\s+|\s+$', '', 'g') AS precinct_clean,
    street_name_clean,
    CASE WHEN regexp_matches(street_name_clean, '\b(AVE|AVENUE)\b') THEN 1 ELSE 0 END AS is_avenue,
    CASE WHEN regexp_matches(street_name_clean, '\b(ST|STREET)\b') THEN 1 ELSE 0 END AS is_street,
    CASE WHEN regexp_matches(street_name_clean, '\bBROADWAY\b') THEN 1 ELSE 0 END AS is_broadway,
    round_even(latitude * 200, 0) / 200 AS lat_grid, round_even(longitude * 200, 0) / 200 AS lon_grid,
    regexp_replace(violation_code, '^\s+|\s+$', '', 'g') AS violation_code_clean,
    agency,
    CASE WHEN fine_amount IS NULL THEN 0 ELSE 1 END AS has_fine,
    CAST(coalesce(fine_amount, 0) AS DOUBLE) AS fine_amount_clean,
    plate_type_clean,
    CASE WHEN plate_type_clean IN ('PAS','COM','OMT','OMS','SRF','MED','PHS') THEN plate_type_clean ELSE 'OTHER' END
      AS plate_type_grouped
  FROM hours
)"""

NUMERIC = """day_of_week, day_of_month, month, week_of_year, year, is_weekend, is_rush_hour, is_asp_day,
  is_avenue, is_street, is_broadway, fine_amount_clean"""
FINAL = f"""
final AS (
  SELECT summons_number, coalesce(hour, 12) AS hour, {NUMERIC},
         borough, coalesce(precinct_clean, 'UNKNOWN') AS precinct_clean, time_of_day, agency, plate_type_grouped,
         violation_code
  FROM feature WHERE issue_date IS NOT NULL AND violation_code IS NOT NULL
)"""
CATEGORICAL = ["borough", "precinct_clean", "time_of_day", "agency", "plate_type_grouped"]
VOCABULARY = (
    "words AS ("
    + " UNION ".join(f"SELECT '{c}' AS feature, {c} AS value FROM final WHERE {c} IS NOT NULL" for c in CATEGORICAL)
    + " UNION "
    + " UNION ".join(f"SELECT '{c}', 'UNKNOWN'" for c in CATEGORICAL)
    + """),
vocabulary AS (
  SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INT) AS code FROM words
)"""
)

PARTS = """
enough AS (
  SELECT violation_code, count(*) AS n, row_number() OVER (ORDER BY violation_code) - 1 AS label
  FROM final GROUP BY violation_code HAVING count(*) >= 10
),
ranked AS (
  SELECT summons_number, n, label,
    row_number() OVER (PARTITION BY violation_code ORDER BY md5('42|' || summons_number), summons_number) AS r
  FROM final JOIN enough USING (violation_code)
),
parts AS (
  SELECT *, CASE WHEN r <= round(n * 0.2) THEN 'test'
                 WHEN r <= round(n * 0.2) + round((n - round(n * 0.2)) * 0.1) THEN 'validation' ELSE 'train' END AS split
  FROM ranked
)"""

KEPT = """
counts AS (SELECT violation_code, count(*) AS n FROM citation WHERE violation_code IS NOT NULL GROUP BY 1),
kept AS (
  SELECT summons_number, violation_code, n FROM citation JOIN counts USING (violation_code) WHERE n >= 10
)"""

PREDICTION = """
prediction AS (
  SELECT summons_number, CAST(vc AS INT) AS label, CAST((vc + k % 7) % 50 AS INT) AS prediction,
         CAST(1 + k % 7 AS INT) AS true_rank
  FROM citation WHERE violation_code IS NOT NULL AND violation_code <> '99'
)"""
NAMED = """
named AS (
  SELECT value, row_number() OVER (ORDER BY value) - 1 AS code
  FROM (SELECT DISTINCT lpad(label::VARCHAR, 2, '0') AS value FROM prediction)
)"""
PER_CLASS = """
classes AS (SELECT DISTINCT unnest([label, prediction]) AS class FROM prediction),
scores AS (
  SELECT class,
    (SELECT count(*) FROM prediction WHERE label = class AND prediction = class) AS hits,
    (SELECT count(*) FROM prediction WHERE label = class) AS support,
    (SELECT count(*) FROM prediction WHERE prediction = class) AS predicted
  FROM classes
),
per_class AS (
  SELECT class,
    coalesce(hits / nullif(predicted, 0), 0.0) AS precision,
    coalesce(hits / nullif(support, 0), 0.0) AS recall,
    coalesce(2 * hits / nullif(support + predicted, 0), 0.0) AS f1,
    support
  FROM scores
)"""
AVERAGES = "averages AS (" + " UNION ALL ".join(
    f"SELECT '{kind}' AS average, " + ", ".join(f"round({mean.format(s)}, 9) AS {s}" for s in ("precision", "recall", "f1"))
    + " FROM per_class"
    for kind, mean in (("macro", "avg({0})"), ("weighted", "sum({0} * support) / sum(support)"))
) + ")"

TABLE_COLUMNS = [
    ("summons_number", "string", "NO"), ("source_dataset", "string", "NO"), ("issue_date", "date", "YES"),
    ("violation_time", "string", "YES"), ("violation_code", "string", "YES"), ("violation_desc", "string", "YES"),
    ("issuing_agency", "string", "YES"), ("county", "string", "YES"), ("precinct", "string", "YES"),
    ("street_name", "string", "YES"), ("intersecting_street", "string", "YES"), ("latitude", "double", "YES"),
    ("longitude", "double", "YES"), ("fine_amount", "decimal(10,2)", "YES"), ("plate_id", "string", "YES"),
    ("registration_state", "string", "YES"), ("plate_type", "string", "YES"), ("soda_row_id", "string", "YES"),
    ("soda_created_at", "timestamp", "YES"), ("soda_updated_at", "timestamp", "YES"), ("ingested_at", "timestamp", "NO"),
]

SCAN = """summons_number, CAST(issue_date AS VARCHAR) AS issue_date, violation_time, violation_code, violation_desc,
  issuing_agency, county, precinct, street_name, intersecting_street,
  CAST(fine_amount AS DOUBLE) AS fine_amount, plate_type, registration_state"""
TRAINING = """summons_number, CAST(issue_date AS VARCHAR) AS issue_date, violation_time, violation_code, violation_desc,
  issuing_agency, county, precinct, street_name, CAST(fine_amount AS DOUBLE) AS fine_amount, plate_type"""
POINT = "latitude IS NOT NULL AND longitude IS NOT NULL"
MODE = "mode() WITHIN GROUP (ORDER BY violation_code)"


def _q(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([CITATION, *ctes]) + "\n" + body


BY_VIOLATION = f"""SELECT violation_code, violation_desc, count(*) AS ticket_count,
  count(DISTINCT precinct) AS precinct_count, {FINE} AS avg_fine,
  CAST(min(issue_date) AS VARCHAR) AS first_ticket, CAST(max(issue_date) AS VARCHAR) AS last_ticket
  FROM citation GROUP BY violation_code, violation_desc"""
BY_LOCATION = f"""SELECT precinct, county, count(*) AS ticket_count,
  count(DISTINCT violation_code) AS violation_types, {FINE} AS avg_fine,
  CAST(sum(fine_amount) AS DOUBLE) AS total_fines
  FROM citation GROUP BY precinct, county"""

VIEWS = {
    "location_risk_scores": f"""SELECT round(latitude, 3) AS lat_grid, round(longitude, 3) AS lon_grid,
  count(*) AS total_tickets, count(DISTINCT violation_code) AS violation_types,
  count(DISTINCT issue_date) AS active_days,
  CAST(count(*) AS DOUBLE) / nullif(count(DISTINCT issue_date), 0) AS avg_daily_tickets,
  {FINE} AS avg_fine, {MODE} AS most_common_violation
  FROM citation WHERE {POINT} GROUP BY 1, 2""",
    "temporal_patterns": f"""SELECT {DOW} AS day_of_week, {STRICT} AS hour_of_day, precinct,
  count(*) AS ticket_count, {FINE} AS avg_fine
  FROM citation WHERE violation_time IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10""",
    "precinct_stats": f"""SELECT precinct, county, count(*) AS total_tickets,
  count(DISTINCT violation_code) AS unique_violations, count(DISTINCT issuing_agency) AS agencies_active,
  CAST(min(issue_date) AS VARCHAR) AS first_ticket_date, CAST(max(issue_date) AS VARCHAR) AS last_ticket_date,
  {FINE} AS avg_fine, CAST(sum(fine_amount) AS DOUBLE) AS total_fines,
  CAST(SUM(CAST(latitude AS DECIMAL(18,6))) AS DOUBLE) / nullif(count(latitude), 0) AS centroid_lat,
  CAST(SUM(CAST(longitude AS DECIMAL(18,6))) AS DOUBLE) / nullif(count(longitude), 0) AS centroid_lon
  FROM citation WHERE precinct IS NOT NULL GROUP BY precinct, county""",
    "street_stats": f"""SELECT upper(trim(street_name)) AS street_name_clean, precinct, county,
  count(*) AS ticket_count, count(DISTINCT violation_code) AS violation_types, {FINE} AS avg_fine,
  {MODE} AS most_common_violation
  FROM citation WHERE length(trim(street_name)) > 0 GROUP BY 1, 2, 3 HAVING count(*) >= 50""",
    "violation_stats": f"""SELECT violation_code, violation_desc, count(*) AS total_tickets,
  count(DISTINCT precinct) AS precincts_affected, count(DISTINCT county) AS counties_affected,
  CAST(min(fine_amount) AS DOUBLE) AS min_fine, {FINE} AS avg_fine, CAST(max(fine_amount) AS DOUBLE) AS max_fine,
  CAST(min(issue_date) AS VARCHAR) AS first_seen, CAST(max(issue_date) AS VARCHAR) AS last_seen
  FROM citation GROUP BY violation_code, violation_desc""",
    "monthly_trends": """SELECT CAST(CAST(date_trunc('month', issue_date) AS DATE) AS VARCHAR) AS month, precinct,
  violation_code, count(*) AS ticket_count, CAST(sum(fine_amount) AS DOUBLE) AS total_fines
  FROM citation WHERE issue_date IS NOT NULL GROUP BY 1, 2, 3""",
    "agency_stats": f"""SELECT issuing_agency, county, count(*) AS total_tickets,
  count(DISTINCT violation_code) AS violation_types, count(DISTINCT precinct) AS precincts_covered,
  {FINE} AS avg_fine, {MODE} AS most_issued_violation
  FROM citation WHERE issuing_agency IS NOT NULL GROUP BY issuing_agency, county""",
}

ORACLES = {
    "ticket_scan": _q(f"SELECT {SCAN} FROM citation WHERE county = 'NY' OR violation_code = '7'"),
    "ticket_scan_limit": _q(
        "SELECT summons_number, violation_code, plate_id FROM citation ORDER BY summons_number LIMIT 1000"
    ),
    "clustered_limit": _q("SELECT summons_number, violation_code, plate_id FROM citation ORDER BY summons_number LIMIT 1000"),
    "clustered_limit_where": _q("SELECT summons_number, county FROM citation WHERE county = 'K' ORDER BY summons_number LIMIT 200"),
    "clustered_chunk": _q("SELECT summons_number, plate_id FROM citation ORDER BY summons_number LIMIT 1234 OFFSET 3702"),
    "geo_scan": _q(
        f"SELECT summons_number, precinct, latitude, longitude FROM citation WHERE {POINT} AND (precinct = '19' OR county = 'K')"
    ),
    "chunk_totals": _q("SELECT count(*) AS total_rows, true AS within_size FROM citation"),
    "training_load": _q(
        f"""SELECT {TRAINING}, latitude, longitude FROM citation
  WHERE issue_date >= DATE '1995-01-01' AND issue_date < DATE '1997-01-01' AND county IN ('NY', 'K', 'Q') AND {POINT}"""
    ),
    "training_sample": _q(
        f"""SELECT {TRAINING} FROM citation
  WHERE md5('42:' || summons_number) < '1999999999999a000000000000000000' AND issue_date >= DATE '1995-01-01'"""
    ),
    "training_sample_high": _q(f"SELECT {TRAINING} FROM citation WHERE md5('42:' || summons_number) < 'ffffef39085f48000000000000000000'"),
    "evaluation_sample": _q(
        "SELECT summons_number FROM final WHERE md5('43:' || summons_number) < '1999999999999a000000000000000000'", FEATURES, FINAL
    ),
    "csv_roundtrip": _q(f"SELECT {SCAN}, latitude, longitude FROM citation"),
    "table_info": _q(
        " UNION ALL ".join(
            f"""SELECT {i} AS ordinal_position, '{name}' AS column_name, '{kind}' AS data_type, '{nullable}' AS is_nullable,
  count(*) - count({name}) AS null_rows FROM citation"""
            for i, (name, kind, nullable) in enumerate(TABLE_COLUMNS, start=1)
        )
    ),
    "row_count": _q("SELECT count(*) AS row_count FROM citation"),
    "date_range": _q(
        """SELECT CAST(min(issue_date) AS VARCHAR) AS first_date, CAST(max(issue_date) AS VARCHAR) AS last_date
  FROM citation"""
    ),
    "adhoc_sql": _q(
        """SELECT precinct, count(*) AS ticket_count FROM citation
  WHERE county = 'K' AND fine_amount >= 50 GROUP BY precinct"""
    ),
    "violation_summary": _q(BY_VIOLATION),
    "location_summary": _q(BY_LOCATION),
    "temporal_distribution": _q(
        f"""SELECT {DOW} AS day_of_week, {STRICT} AS hour_of_day, count(*) AS ticket_count,
    CAST(count(*) OVER () AS INT) AS total_slots
  FROM citation WHERE violation_time IS NOT NULL GROUP BY 1, 2"""
    ),
    "fine_distribution": _q(
        f"""SELECT violation_code, violation_desc, CAST(min(fine_amount) AS DOUBLE) AS min_fine, {FINE} AS avg_fine,
  CAST(max(fine_amount) AS DOUBLE) AS max_fine,
  percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(fine_amount AS DOUBLE)) AS median_fine,
  count(*) AS ticket_count
  FROM citation WHERE fine_amount IS NOT NULL GROUP BY violation_code, violation_desc"""
    ),
    "violations_top": _q(
        """SELECT *, (SELECT count(*) FROM grouped) AS total_count FROM grouped
  ORDER BY ticket_count DESC, violation_code ASC NULLS LAST, violation_desc ASC NULLS LAST LIMIT 50""",
        f"grouped AS ({BY_VIOLATION})",
    ),
    "hotspots_top": _q(
        """SELECT *, (SELECT count(*) FROM grouped) AS total_locations FROM grouped
  ORDER BY ticket_count DESC, precinct ASC NULLS LAST, county ASC NULLS LAST LIMIT 50""",
        f"grouped AS ({BY_LOCATION})",
    ),
    "heatmap_points": _q(
        f"""SELECT latitude, longitude, violation_code, CAST(count(*) OVER () AS INT) AS point_count FROM (
    SELECT * FROM citation
    WHERE issue_date >= DATE '1995-01-01' AND issue_date < DATE '1997-01-01' AND violation_code = '7' AND {POINT}
    ORDER BY summons_number LIMIT 1000)"""
    ),
    "class_counts": _q(
        """SELECT violation_code, count(*) AS class_rows FROM citation
  WHERE violation_code IS NOT NULL GROUP BY violation_code"""
    ),
    "class_total": _q("SELECT count(DISTINCT violation_code) AS classes FROM citation"),
    **{name: _q(sql) for name, sql in VIEWS.items()},
    "view_roundtrip": _q(VIEWS["monthly_trends"]),
    "view_refresh": _q(
        " UNION ALL ".join(
            f"SELECT '{name}' AS view_name, count(*) AS view_rows FROM ({sql})" for name, sql in VIEWS.items()
        )
    ),
    "features_temporal": _q(
        """SELECT summons_number, year, month, day_of_week, day_of_month, week_of_year, is_weekend, hour, time_of_day,
  is_rush_hour, is_asp_day FROM feature""",
        FEATURES,
    ),
    "features_location": _q(
        f"""SELECT summons_number, borough, precinct_clean, street_name_clean, is_avenue, is_street, is_broadway,
  lat_grid, lon_grid, lat_grid::VARCHAR || '_' || lon_grid::VARCHAR AS location_cell FROM feature WHERE {POINT}""",
        FEATURES,
    ),
    "features_violation": _q(
        """SELECT summons_number, violation_code_clean, agency, has_fine, fine_amount_clean, plate_type_clean,
  plate_type_grouped FROM feature""",
        FEATURES,
    ),
    "features_final": _q("SELECT * FROM final", FEATURES, FINAL),
    "rare_class_filter": _q("SELECT summons_number, violation_code FROM kept", KEPT),
    "rare_class_rows": _q(
        """SELECT coalesce(sum(n), 0)::BIGINT AS removed_rows, count(*) AS removed_classes FROM counts WHERE n < 10""",
        KEPT,
    ),
    "vocabulary": _q("SELECT * FROM vocabulary", FEATURES, FINAL, VOCABULARY),
    "encoded_features": _q(
        f"SELECT summons_number, hour, {NUMERIC}, "
        + ", ".join(f"v_{c}.code AS {c}" for c in CATEGORICAL)
        + " FROM final "
        + " ".join(
            f"JOIN vocabulary v_{c} ON v_{c}.feature = '{c}' AND v_{c}.value = coalesce(final.{c}, 'UNKNOWN')"
            for c in CATEGORICAL
        ),
        FEATURES,
        FINAL,
        VOCABULARY,
    ),
    "encoded_target": _q(
        """SELECT summons_number, violation_code,
  CAST(dense_rank() OVER (ORDER BY violation_code) - 1 AS INT) AS label FROM final""",
        FEATURES,
        FINAL,
    ),
    "stratified_split": _q(
        """SELECT summons_number, violation_code,
  CASE WHEN r <= round(n * 0.2) THEN 'test' WHEN r <= round(n * 0.2) + round((n - round(n * 0.2)) * 0.1) THEN 'validation'
       ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY violation_code ORDER BY md5('42|' || summons_number), summons_number) AS r
        FROM kept)""",
        KEPT,
    ),
    "metric_accuracy": _q(
        "SELECT CAST(count(*) FILTER (label = prediction) AS DOUBLE) / count(*) AS accuracy FROM prediction", PREDICTION
    ),
    "metric_topk": _q(
        """SELECT k, CAST(count(*) FILTER (true_rank <= k) AS DOUBLE) / count(*) AS accuracy
  FROM prediction, (VALUES (1), (3), (5)) AS ks(k) GROUP BY k""",
        PREDICTION,
    ),
    "metric_per_class": _q("SELECT * FROM per_class", PREDICTION, PER_CLASS),
    "metric_averages": _q("SELECT * FROM averages", PREDICTION, PER_CLASS, AVERAGES),
    "confusion_topn": _q(
        """SELECT label, prediction, count(*) AS pair_rows, l.value AS label_name, p.value AS prediction_name
  FROM prediction LEFT JOIN named l ON l.code = label LEFT JOIN named p ON p.code = prediction
  WHERE label IN (SELECT label FROM prediction GROUP BY label ORDER BY count(*) DESC, label LIMIT 20)
  GROUP BY ALL""",
        PREDICTION,
        NAMED,
    ),
    "metric_report": _q(
        """SELECT 'overall' AS section, 'accuracy' AS name,
    round(CAST(count(*) FILTER (label = prediction) AS DOUBLE) / count(*), 9) AS value FROM prediction
  UNION ALL SELECT 'overall', 'top_' || k || '_accuracy',
    round(CAST(count(*) FILTER (true_rank <= k) AS DOUBLE) / count(*), 9)
    FROM prediction, (VALUES (3), (5)) AS ks(k) GROUP BY k
  UNION ALL SELECT 'overall', average || '_' || unnest(['precision', 'recall', 'f1']), unnest([precision, recall, f1]) FROM averages
  UNION ALL SELECT 'class ' || coalesce(value, class::VARCHAR), unnest(['precision', 'recall', 'f1', 'support']),
    unnest([round(precision, 9), round(recall, 9), round(f1, 9), support::DOUBLE])
    FROM per_class LEFT JOIN named ON code = class""",
        PREDICTION,
        NAMED,
        PER_CLASS,
        AVERAGES,
    ),
    "topk_classes": _q(
        """SELECT summons_number, rank, probability, ranked.code, value AS violation_code
  FROM (
    SELECT summons_number, CAST(row_number() OVER (PARTITION BY summons_number ORDER BY probability DESC, code DESC) AS INT) AS rank,
           probability, code
    FROM (
      SELECT summons_number, label, code, CASE WHEN behind < 7 THEN (64 >> behind) / 128.0::DOUBLE ELSE 0.0::DOUBLE END AS probability
      FROM (SELECT *, (prediction - code + 50) % 50 AS behind
            FROM prediction, (SELECT CAST(unnest(range(50)) AS INT) AS code))
      WHERE label % 10 <> 3 AND (label % 10 <> 4 OR code < 2)
    )
  ) ranked LEFT JOIN named ON ranked.code = named.code WHERE rank <= 5
  UNION ALL SELECT summons_number, NULL, NULL, NULL, NULL FROM prediction WHERE label % 10 = 3""",
        PREDICTION,
        NAMED,
    ),
    **{f"view_apply_{name}": _q(sql) for name, sql in VIEWS.items()},
    **{f"view_refresh_{name}": _q(VIEWS[name]) for name in ("precinct_stats", "violation_stats", "monthly_trends")},
    **{
        name: _q(
            "SELECT summons_number, split, CAST(label AS INT) AS label, true AS sums_to_one, true AS is_arg_max, "
            "true AS one_per_class FROM parts WHERE split <> 'train'",
            FEATURES, FINAL, PARTS,
        )
        for name in ("train_predict_facts", "boosted_predict_facts")
    },
    "boosted_rounds_facts": _q(
        """SELECT split, CAST(round AS INT) AS round, count(*) AS rows, CASE WHEN split = 'train' THEN true END AS falls
  FROM parts, range(1, 9) AS r(round) GROUP BY split, round""",
        FEATURES, FINAL, PARTS,
    ),
    "boosted_saved_facts": _q("SELECT summons_number, true AS unchanged FROM parts WHERE split <> 'train'", FEATURES, FINAL, PARTS),
    "boosted_first_splits": _q(
        """SELECT CAST(place AS INT) AS place, feature, value AS cut, round(gain, 4) AS gain
  FROM (SELECT *, row_number() OVER (ORDER BY gain DESC, feature) AS place
        FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, value) AS r FROM gains) WHERE r = 1)
  WHERE place <= 10""",
        FEATURES, FINAL, VOCABULARY,
        "entries AS ("
        + " UNION ALL ".join(
            f"SELECT '{c.strip()}' AS feature, CAST({c.strip()} AS DOUBLE) AS value, violation_code FROM final" for c in ["hour", *NUMERIC.split(",")]
        )
        + "".join(
            f" UNION ALL SELECT '{c}', CAST(code AS DOUBLE), violation_code FROM final JOIN vocabulary "
            f"ON feature = '{c}' AND vocabulary.value = coalesce(final.{c}, 'UNKNOWN')"
            for c in CATEGORICAL
        )
        + """),
classes AS (SELECT violation_code, count(*) AS total FROM final GROUP BY 1),
unit AS (SELECT k, round_even((1.0 / k) * 1048576, 0) AS other, round_even((1.0 / k - 1) * 1048576, 0) AS own,
    round_even(2 * (1.0 / k) * (1 - 1.0 / k) * 1048576, 0) / 1048576 AS h, n
  FROM (SELECT CAST(count(*) AS DOUBLE) AS k, CAST(sum(total) AS DOUBLE) AS n FROM classes)),
cells AS (SELECT feature, value, violation_code, count(*) AS n FROM entries GROUP BY ALL),
grid AS (SELECT feature, value, violation_code, total, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT feature, value FROM entries) CROSS JOIN classes LEFT JOIN cells USING (feature, value, violation_code)),
below AS (SELECT feature, value, total, sum(n) OVER (PARTITION BY feature, violation_code ORDER BY value) AS c FROM grid),
counted AS (SELECT *, sum(c) OVER (PARTITION BY feature, value) AS m FROM below),
sums AS (SELECT feature, value, m, unit.n, k, h, (m * other + c * (own - other)) / 1048576 AS gl,
    (unit.n * other + total * (own - other)) / 1048576 AS g FROM counted, unit),
gains AS (SELECT feature, value,
    0.5 * (sum(gl * gl / (m * h + 1)) + sum((g - gl) * (g - gl) / ((n - m) * h + 1)) - sum(g * g / (n * h + 1))) AS gain
  FROM sums WHERE least(m, n - m) * k * h >= 5 GROUP BY feature, value HAVING gain > 1e-9)""",
    ),
    "feature_importance_facts": "SELECT unnest(["
    + ", ".join(f"'{c.strip()}'" for c in ["hour", *NUMERIC.split(","), *CATEGORICAL])
    + "]) AS feature, true AS not_negative, true AS sums_to_one",
    "model_info_facts": _q(
        "SELECT 'violation_code' AS target, '"
        + ",".join(c.strip() for c in ["hour", *NUMERIC.split(","), *CATEGORICAL])
        + "' AS features, count(DISTINCT violation_code) AS num_classes FROM final",
        FEATURES,
        FINAL,
    ),
    "saved_model_facts": _q(
        """SELECT 'overall' AS section, unnest(['accuracy', 'top_3_accuracy', 'top_5_accuracy', 'macro_precision', 'macro_recall',
    'macro_f1', 'weighted_precision', 'weighted_recall', 'weighted_f1']) AS name, NULL::DOUBLE AS support, true AS unchanged
  UNION ALL SELECT 'class ' || violation_code, unnest(['precision', 'recall', 'f1', 'support']),
    unnest([NULL, NULL, NULL, count(*)::DOUBLE]), true FROM final GROUP BY violation_code HAVING count(*) >= 10
  UNION ALL SELECT 'feature', 'any', NULL, true FROM range(15)""",
        FEATURES,
        FINAL,
    ),
    "score_requests_facts": _q(
        """SELECT summons_number AS request_id,
    CASE WHEN m % 20 = 0 OR issue_date IS NULL THEN '2024-01-15 14:30:00'
         ELSE strftime(issue_date + to_minutes(m), '%Y-%m-%d %H:%M:%S') END AS datetime,
    coalesce(precinct, 'UNKNOWN') AS precinct, coalesce(county, 'NY') AS county, latitude, longitude,
    CASE WHEN m % 20 = 0 THEN 'unreadable datetime' END AS error, CASE WHEN m % 20 <> 0 THEN true END AS answered
  FROM (SELECT *, CAST(split_part(summons_number, '-', 1) AS BIGINT) % 1440 AS m FROM citation)"""
    ),
}
