"""Puts together DuckDB SQL from named common table expressions."""

from __future__ import annotations

import re

from ..plans import model

CTES: dict[str, str] = {}


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


def sql(body: str) -> str:
    """body with the expressions it names, and those they name, before it."""
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                needed[name] = None

    visit(body)
    if not needed:
        return body
    parts = [f"{n} AS ({CTES[n]})" for n in needed]
    inner = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    head = "WITH RECURSIVE " if inner and inner[1] else "WITH "
    return head + ",\n".join(parts) + (",\n" + body[inner.end() :] if inner else "\n" + body)


def rnd(x: str, digits: int) -> str:
    return f"round(({x}) + 1e-9, {digits})"


def place(i: str) -> str:
    """Where match i begins, from 0, in a row with matches h and the pieces between them g."""
    return f"(list_sum(list_transform(g[1:{i}], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:{i} - 1], lambda x: length(x))), 0))"


def around(before: int, after: int) -> str:
    """The windows of all matches in a row with text t, matches h and the pieces between them g."""
    a = place("i")
    return f"list_transform(range(1, len(h) + 1), lambda i: substr(t, greatest({a} - {before}, 0)::BIGINT + 1, ({a} + length(h[i]) + {after} - greatest({a} - {before}, 0))::BIGINT))"


CTES |= {
    "dim_option": values(model.option_rows(), "layer, q, question_id, domain, weight, n_options, option_index, alignment, basis"),
    "dim_feature": values(model.feature_rows(), "feature, domain, access, weight, gwas, basis"),
    "dim_mapper": values(model.mapper_rows(), "f, feature, lo, hi, sex_adjusted"),
    "dim_segment": values(model.segment_rows(), "feature, sex, x0, x1, a0, slope"),
    "dim_construct": values([(q, f) for q, fs in model.CONSTRUCTS.items() for f in fs], "question_id, feature"),
    "dim_rule": values(model.domain_rule_rows(), "name, key, kind"),
    "dim_quality": values(list(model.BASIS_QUALITY.items()), "basis, quality"),
    "dim_clock": values([(c, *x) for c, x in model.CLOCKS.items()], "clock_name, output_type, mapper, scoreable, status"),
    "subjects": "SELECT c_custkey::BIGINT AS subject_id, (18 + c_custkey % 72)::INTEGER AS age, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, c_nationkey::INTEGER AS country FROM customer",
    "raw_answers": """SELECT subject_id, CASE WHEN subject_id % 89 = 0 AND q = 1 THEN 'q_unknown' ELSE question_id END AS question_id,
      CASE WHEN subject_id % 97 = 0 AND q = 0 THEN 99 ELSE (subject_id * 7 + q * 3) % n_options END::INTEGER AS option_index
      FROM subjects, (SELECT DISTINCT q, question_id, n_options FROM dim_option WHERE layer = 2) WHERE (subject_id + q) % 5 <> 0""",
    "checked": """SELECT a.*, CASE WHEN n_options IS NULL THEN 'unknown' WHEN option_index IS NULL THEN 'invalid' WHEN option_index NOT BETWEEN 0 AND n_options - 1 THEN 'out_of_range' END AS reason
      FROM raw_answers a LEFT JOIN (SELECT DISTINCT question_id, n_options FROM dim_option WHERE layer = 2) USING (question_id)""",
    "answers": "SELECT subject_id, question_id, option_index FROM checked WHERE reason IS NULL",
    "readings": """SELECT subject_id, CASE WHEN subject_id % 11 = 0 THEN NULL WHEN subject_id % 2 = 0 THEN 'F' ELSE 'M' END AS sex, feature, value FROM (
      SELECT o_custkey::BIGINT AS subject_id, feature, lo + (hi - lo) * (l_quantity / 50.0::DOUBLE) AS value,
        row_number() OVER (PARTITION BY o_custkey, feature ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS rn
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN dim_mapper ON l_partkey % 18 = f) WHERE rn = 1""",
    "mapped": """SELECT subject_id, feature, target, alignment, CASE WHEN lo IS NULL THEN 'unmapped' WHEN value IS NULL THEN 'missing' WHEN scored THEN 'scored' ELSE 'not_scoreable' END AS status,
      concat_ws(',', CASE WHEN value IS NULL THEN 'missing' END, CASE WHEN v <> value THEN 'clamped' END, CASE WHEN sex_adjusted AND coalesce(sex NOT IN ('M', 'F'), TRUE) AND value IS NOT NULL THEN 'pooled_sex' END) AS warnings
      FROM (SELECT r.*, m.lo, m.sex_adjusted, least(greatest(value, m.lo), m.hi) AS v, CASE WHEN r.feature = 'ldl_cholesterol' THEN 'cholesterol' ELSE r.feature END AS target,
        EXISTS (SELECT 1 FROM dim_feature d WHERE d.feature = CASE WHEN r.feature = 'ldl_cholesterol' THEN 'cholesterol' ELSE r.feature END) AS scored,
        (SELECT """ + rnd("s.a0 + s.slope * (least(greatest(value, m.lo), m.hi) - greatest(s.x0, -1e9))", 4) + """ FROM dim_segment s WHERE s.feature = r.feature
          AND s.sex = CASE WHEN r.sex = 'F' THEN 'F' ELSE 'M' END AND least(greatest(value, m.lo), m.hi) >= s.x0 AND least(greatest(value, m.lo), m.hi) < s.x1) AS alignment
        FROM readings r LEFT JOIN dim_mapper m USING (feature))""",
    "clinical": "SELECT subject_id, target AS feature, arg_min(alignment, CASE WHEN feature = target THEN 0 ELSE 1 END) AS alignment FROM mapped WHERE status = 'scored' GROUP BY subject_id, target",
    "quiz2": "SELECT subject_id, question_id AS feature, domain, weight, alignment, basis, FALSE AS gwas, 2 AS layer, weight AS eff_weight FROM answers JOIN dim_option o USING (question_id, option_index) WHERE o.layer = 2",
    "items3": """SELECT * FROM quiz2 q WHERE NOT EXISTS (SELECT 1 FROM clinical c JOIN dim_construct d USING (feature) WHERE c.subject_id = q.subject_id AND d.question_id = q.feature)
      UNION ALL SELECT subject_id, feature, domain, weight, alignment, basis, gwas, 3, weight * (1 + CASE WHEN gwas THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) FROM clinical JOIN dim_feature USING (feature)""",
    "totals3": "SELECT subject_id, count(*) AS n_items, sum(eff_weight) AS w, sum(eff_weight * alignment) AS wa, sum(eff_weight * alignment * alignment) AS waa, sum(CASE WHEN gwas THEN eff_weight ELSE 0 END) AS gw, max(layer) AS layer FROM items3 GROUP BY subject_id",
    "scores2": "SELECT subject_id, " + rnd("100 * sum(eff_weight * alignment) / sum(eff_weight)", 1) + " AS score FROM quiz2 GROUP BY subject_id",
    "cohort": """SELECT subject_id, age, sex, (sex = 'M')::INTEGER AS male, CASE WHEN age < 50 THEN '18-49' WHEN age < 65 THEN '50-64' WHEN age < 75 THEN '65-74' ELSE '75+' END AS age_band, score,
      ((subject_id * 13 + age) % 100 < age - 15)::INTEGER AS deceased, (1 + (subject_id * 31) % 230)::INTEGER AS permth_exm,
      greatest(0.1::DOUBLE, (1 + (subject_id * 31) % 230) / 12.0::DOUBLE) AS t_years FROM subjects JOIN scores2 USING (subject_id)""",
    "mentions": """SELECT p_type AS biomarker_name, (l_orderkey // 8)::BIGINT AS study_id, (l_orderkey * 10 + l_linenumber)::BIGINT AS ord, (['OR', 'HR', 'RR'])[l_suppkey % 3 + 1] AS effect_measure,
      CASE WHEN l_suppkey % 2 = 0 THEN 'centenarian' ELSE 'unspecified' END AS subject_class, 0.5 + l_quantity / 25.0::DOUBLE AS value,
      CASE WHEN l_returnflag <> 'N' THEN (0.5 + l_quantity / 25.0::DOUBLE) / (1.2::DOUBLE + l_discount::DOUBLE) END AS ci_lower,
      CASE WHEN l_returnflag <> 'N' THEN (0.5 + l_quantity / 25.0::DOUBLE) * (1.2::DOUBLE + l_discount::DOUBLE) END AS ci_upper FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "life": """SELECT n_nationkey::INTEGER AS country_code, n_name AS country_name, sex, year, age, lx, floor(lx / 40) / 100 AS ex, n_nationkey % 7 = 0 AND age = 110 AS warning FROM (
      SELECT *, greatest(1, 100000 - 12 * (age - 60) * (age - 60) * (1 + n_nationkey % 5) - (year - 2019))::DOUBLE AS lx
      FROM nation, (SELECT unnest(['female', 'male', 'both']) AS sex), (SELECT unnest([2019, 2021]) AS year), (SELECT unnest(range(60, 111)) AS age))""",
}
