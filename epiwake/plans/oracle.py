"""DuckDB statements that state each registered query a second time, independently."""

from __future__ import annotations

BASE = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
visit AS (
  SELECT event_id AS id, user_id * 10 + k % 10 AS patient_id,
    event_id % (SELECT count(*) FROM supplier) AS doctor_id,
    CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
      WHEN 'signup' THEN 4 ELSE 5 END::BIGINT AS disease_id,
    CAST(ts AS DATE) AS diagnosis_date,
    CASE WHEN k % 4 = 0 THEN 'cured' ELSE 'infected' END AS status,
    40.0::DOUBLE + k * 0.5::DOUBLE AS weight, (user_id % 60 + 130)::DOUBLE AS height,
    (['single','married','divorced','widow'])[(k % 4 + 1)::INT] AS marital_status
  FROM ev),
disease AS (SELECT * FROM (VALUES
  (1::BIGINT,'MEA','Measles','viral','airborne',5,4.5::DOUBLE,'high_priority',true,false),
  (2,'COL','Cholera','bacterial','water',4,3.0,'cluster_sensitive',false,false),
  (3,'POL','Polio','viral','fecal_oral',5,4.0,'rare',true,true),
  (4,'FLU','Seasonal flu','viral','droplet',2,1.5,'general',false,false),
  (5,'1E32','Influenza','respiratory','droplet',4,0.67,'surge_sensitive',false,false))
  AS t(id, disease_code, name, type, transmission_vector, risk_level, infection_score,
       policy_profile, high_priority, rare_disease)),
patient AS (
  SELECT c_custkey AS id, c_name AS national_number, c_name AS name,
    DATE '1940-01-01' + (c_custkey * 37 % 25000)::INT AS birth_date,
    CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
    33.0::DOUBLE + (c_custkey * 7919 % 10007)::DOUBLE / 20014.0::DOUBLE AS residence_lat,
    36.0::DOUBLE + (c_custkey * 104729 % 10009)::DOUBLE / 20018.0::DOUBLE AS residence_long,
    CASE WHEN c_custkey % 3 <> 0 THEN 33.0::DOUBLE + (c_custkey * 7919 % 10007)::DOUBLE / 20014.0::DOUBLE + 0.004::DOUBLE END AS work_lat,
    CASE WHEN c_custkey % 3 <> 0 THEN 36.0::DOUBLE + (c_custkey * 104729 % 10009)::DOUBLE / 20018.0::DOUBLE + 0.004::DOUBLE END AS work_long
  FROM customer),
home AS (
  SELECT id AS visit_id, patient_id,
    33.0::DOUBLE + (patient_id * 7919 % 10007)::DOUBLE / 20014.0::DOUBLE AS latitude,
    36.0::DOUBLE + (patient_id * 104729 % 10009)::DOUBLE / 20018.0::DOUBLE AS longitude
  FROM visit),
geodata AS (
  SELECT visit_id * 2 AS id, patient_id, visit_id, latitude, longitude, 'home' AS region_type FROM home
  UNION ALL
  SELECT visit_id * 2 + 1, patient_id, visit_id, latitude + 0.004::DOUBLE, longitude + 0.004::DOUBLE, 'work'
  FROM home WHERE patient_id % 3 <> 0),
hospital AS (
  SELECT n_nationkey::BIGINT AS id, n_name AS name, 33.0::DOUBLE + n_nationkey::DOUBLE / 50.0::DOUBLE AS hospital_lat,
    36.0::DOUBLE + n_nationkey::DOUBLE / 50.0::DOUBLE AS hospital_long, r_name AS city
  FROM nation JOIN region ON n_regionkey = r_regionkey),
doctor AS (
  SELECT s_suppkey AS id, s_suppkey AS user_id,
    (['Epidemiology','Internal Medicine'])[(s_suppkey % 2 + 1)::INT] AS specialization,
    s_nationkey::BIGINT AS hospital_id FROM supplier),
users AS (
  SELECT s_suppkey AS id, s_name AS username, s_name || '@example.org' AS email, s_name AS real_name,
    (['doctor','nurse','admin','doctor',''])[(s_suppkey % 5 + 1)::INT] AS role FROM supplier),
report AS (
  SELECT o_orderkey AS id,
    TIMESTAMP '2024-01-01' + to_minutes((o_orderkey % 43200)::INT) AS generated_at,
    coalesce(v.disease_id, o_orderkey % 5 + 1) AS disease_id, v.id AS trigger_visit_id,
    DATE '2024-01-01' + (o_orderkey % 30)::INT AS analysis_period_start,
    DATE '2024-01-01' + (o_orderkey % 30)::INT + (o_custkey % 9 - 1)::INT AS analysis_period_end,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
      WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS alert_level,
    o_totalprice / 5000.0::DOUBLE AS risk_score,
    (o_orderkey % 7)::INT AS nearby_case_count, (o_orderkey % 11)::INT AS current_case_count,
    (o_orderkey % 5)::INT AS previous_case_count, (o_orderkey % 13)::DOUBLE / 4.0::DOUBLE AS growth_rate,
    (o_orderkey % 17)::DOUBLE / 4.0::DOUBLE AS surge_ratio,
    CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'new' ELSE 'reviewed' END AS status
  FROM orders LEFT JOIN visit v ON v.id = o_orderkey),
lab_test AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS visit_id,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'Abnormal high WBC' WHEN 'AO' THEN 'Positive'
      WHEN 'NF' THEN 'Within normal limits' WHEN 'NO' THEN 'Not detected'
      WHEN 'RF' THEN 'Reactive' ELSE 'Low platelets' END AS result,
    l_shipdate AS test_date
  FROM lineitem),
geocluster AS (
  SELECT c_custkey AS id,
    33.0::DOUBLE + ((c_custkey * 3 + 1) * 7919 % 10007)::DOUBLE / 20014.0::DOUBLE AS center_lat,
    36.0::DOUBLE + ((c_custkey * 3 + 1) * 104729 % 10009)::DOUBLE / 20018.0::DOUBLE AS center_long,
    0.5::DOUBLE + (c_custkey % 40)::DOUBLE / 10.0::DOUBLE AS radius, c_custkey % 5 + 1 AS disease_id,
    (c_custkey % 23)::INT AS case_count, (c_custkey % 6)::INT AS risk_level,
    TIMESTAMP '2024-01-01' + to_minutes((c_custkey * 17 % 43200)::INT) AS generated_at
  FROM customer),
latest AS (
  SELECT * FROM visit QUALIFY row_number() OVER (
    PARTITION BY patient_id, disease_id ORDER BY diagnosis_date DESC, id DESC) = 1),
active AS (SELECT * FROM latest WHERE lower(status) = 'infected')"""


def statement(body: str, *steps: str, recursive: bool = False) -> str:
    """Prefix a final SELECT with the adapter tables and any extra named steps."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join([BASE.strip(), *[s.strip() for s in steps]]) + "\n" + body.strip()


MAP_SELECT = """SELECT g.id AS geodata_id, g.visit_id, g.patient_id, d.disease_code, d.type AS disease_type,
  v.doctor_id, doc.hospital_id AS doctor_hospital_id, v.diagnosis_date, v.status, g.region_type
FROM geodata g JOIN {visits} v ON v.id = g.visit_id JOIN disease d ON d.id = v.disease_id
JOIN doctor doc ON doc.id = v.doctor_id {where}
{page}"""

NEWEST = "(SELECT max(diagnosis_date) FROM visit WHERE id IN (SELECT visit_id FROM geodata))"

POLICY_TABLES = """
alias(code, canon) AS (VALUES
 ('MEA','MEASLES'),('MEASLES','MEASLES'),('1F03','MEASLES'),('COL','CHOLERA'),('CHOLERA','CHOLERA'),('1A00','CHOLERA'),
 ('POL','POLIO'),('POLIO','POLIO'),('1C81','POLIO'),('SMPX','SMALLPOX'),('SMALLPOX','SMALLPOX'),('1E70','SMALLPOX'),
 ('HEPA','HEPA'),('1E50.0','HEPA'),('PLG','PLAGUE'),('PLAGUE','PLAGUE'),('1B93','PLAGUE'),('EBOLA','EBOLA'),('1D60.01','EBOLA'),
 ('SARS','SARS'),('1D65','SARS'),('MERS','MERS'),('1D64','MERS'),('MPOX','MPOX'),('1E71','MPOX'),
 ('INFLUENZA','INFLUENZA'),('1E32','INFLUENZA'),('PERTUSSIS','PERTUSSIS'),('1C12','PERTUSSIS'),('TYPHOID','TYPHOID'),('1A07','TYPHOID'),
 ('TUBERCULOSIS','TUBERCULOSIS'),('TB','TUBERCULOSIS'),('1B1Z','TUBERCULOSIS'),('RABIES','RABIES'),('1C82','RABIES'),
 ('MENINGOCOCCAL','MENINGOCOCCAL'),('MENINGOCOCCAL_MENINGITIS','MENINGOCOCCAL'),('1C1C.0','MENINGOCOCCAL'),
 ('DENGUE','DENGUE'),('1D2Z','DENGUE'),('MALARIA','MALARIA'),('1F4Z','MALARIA'),('YELLOW_FEVER','YELLOW_FEVER'),('1D47','YELLOW_FEVER'),
 ('CHIKUNGUNYA','CHIKUNGUNYA'),('1D40','CHIKUNGUNYA'),('ZIKA','ZIKA'),('1D48','ZIKA'),
 ('SALMONELLA_ENTERITIS','SALMONELLA_ENTERITIS'),('1A09.0','SALMONELLA_ENTERITIS'),('SHIGELLA','SHIGELLA'),('1A02','SHIGELLA'),
 ('CAMPYLOBACTER','CAMPYLOBACTER'),('1A06','CAMPYLOBACTER'),('LISTERIOSIS','LISTERIOSIS'),('1C1A.Z','LISTERIOSIS')),
profile_rule(key, hp, rare, l, b, r, sev, den, tre, rar, clu, cri) AS (VALUES
 ('high_priority', true, NULL, 10, 21, 3.0, 1.9, 1.35, 1.25, NULL, 2, 4),
 ('rare', true, true, 30, 30, 10.0, 2.3, 1.5, 1.2, 3.0, 1, 1),
 ('cluster_sensitive', NULL, NULL, 7, 14, 2.0, NULL, 1.7, 1.5, NULL, 2, 4),
 ('surge_sensitive', NULL, NULL, 7, 21, 3.0, NULL, 1.2, 1.7, NULL, 3, 5),
 ('environmental_signal', NULL, NULL, 30, 60, 5.0, 0.75, 0.9, 1.25, NULL, 5, 9)),
code_rule(key, hp, rare, l, b, r, sev, den, tre, rar, clu, cri) AS (VALUES
 ('MEASLES', true, NULL, 14, 21, 3.0, 2.2, 1.4, 1.3, NULL, 1, 2),
 ('CHOLERA', NULL, NULL, 7, 14, 3.0, NULL, 1.8, 1.8, NULL, 2, 4),
 ('POLIO', true, true, 30, 30, 10.0, 2.5, 1.5, 1.2, 3.0, 1, 1),
 ('SMALLPOX', true, true, 30, 45, 10.0, 2.6, 1.5, 1.2, 3.2, 1, 1),
 ('PLAGUE', true, true, 21, 30, 6.0, 2.4, 1.5, 1.2, 3.0, 1, 1),
 ('EBOLA', true, true, 21, 30, 8.0, 2.6, 1.4, 1.2, 3.2, 1, 1),
 ('HEPA', NULL, NULL, 5, 14, 2.0, NULL, 1.6, 1.7, NULL, 3, 5),
 ('TYPHOID', NULL, NULL, 7, 14, 2.5, NULL, 1.7, 1.6, NULL, 2, 4),
 ('SALMONELLA_ENTERITIS', NULL, NULL, 3, 10, 1.5, NULL, 1.8, 1.6, NULL, 3, 6),
 ('SHIGELLA', NULL, NULL, 4, 10, 1.5, NULL, 1.8, 1.6, NULL, 3, 6),
 ('CAMPYLOBACTER', NULL, NULL, 4, 10, 1.5, NULL, 1.7, 1.5, NULL, 3, 6),
 ('LISTERIOSIS', NULL, NULL, 7, 21, 2.0, NULL, 1.6, 1.4, NULL, 2, 4),
 ('INFLUENZA', NULL, NULL, 7, 21, 3.0, NULL, 1.1, 1.9, NULL, 4, 7),
 ('PERTUSSIS', true, NULL, 14, 21, 3.0, NULL, 1.4, 1.6, NULL, 2, 4),
 ('TUBERCULOSIS', true, NULL, 30, 60, 2.0, NULL, 1.1, 1.4, NULL, 2, 4),
 ('RABIES', true, NULL, 60, 60, 10.0, 2.4, 1.0, 0.8, NULL, 1, 1),
 ('MENINGOCOCCAL', true, NULL, 10, 21, 2.0, 2.3, 1.4, 1.3, NULL, 1, 2),
 ('MPOX', true, NULL, 14, 21, 3.0, NULL, 1.4, 1.3, NULL, 2, 3),
 ('SARS', true, NULL, 14, 21, 4.0, NULL, 1.5, 1.5, NULL, 1, 2),
 ('MERS', true, NULL, 14, 21, 4.0, NULL, 1.5, 1.5, NULL, 1, 2),
 ('DENGUE', true, NULL, 14, 28, 5.0, NULL, 1.5, 1.4, NULL, 2, 4),
 ('MALARIA', true, NULL, 14, 28, 5.0, NULL, 1.4, 1.3, NULL, 2, 4),
 ('YELLOW_FEVER', true, NULL, 14, 28, 5.0, NULL, 1.5, 1.4, NULL, 1, 2),
 ('CHIKUNGUNYA', true, NULL, 14, 28, 5.0, NULL, 1.3, 1.3, NULL, 2, 4),
 ('ZIKA', true, NULL, 14, 28, 5.0, NULL, 1.3, 1.3, NULL, 2, 4),
 ('FPO', NULL, NULL, 2, 7, 1.0, NULL, 1.9, 1.7, NULL, 4, 8))"""

CLASSIFIED = """
catalogue AS (
  SELECT p_partkey AS id,
    (['MEA','1F03','1A00','1C81','1E70','1E50.0','1B93','1D60.01','1D65','1E71','1E32','1C12','1A07','1B1Z','1C82',
      '1C1C.0','1D2Z','1F4Z','1A09.0','1A02','DA22.Z','CA23','CA40.Z','1A31','FPO','COVID','X1','X2','X3','X4'])[(p_partkey % 30 + 1)::INT] AS disease_code,
    p_name || CASE WHEN p_partkey % 50 = 0 THEN ' Plague' ELSE '' END AS name,
    (['epidemic_infectious','high_alert_notifiable','cancer_environmental_signal','gastrointestinal','respiratory','chronic','other'])[(p_partkey % 7 + 1)::INT] AS type,
    (['airborne_droplet','foodborne','none','vector_mosquito','close_contact'])[(p_partkey % 5 + 1)::INT] AS transmission_vector,
    (p_size % 6)::INT AS risk_level, (p_partkey * 13 % 130)::DOUBLE / 20.0::DOUBLE AS infection_score
  FROM part),
marked AS (SELECT *,
    disease_code IN ('1E70','1C81','1B93','1D60.01') OR regexp_matches(lower(name), 'smallpox|poliomyelitis|plague|ebola') AS rare_disease,
    disease_code IN ('1F03','1E71','1D65','1D64','1D60.01','1C1C.0','1C82','1D2Z','1F4Z','1D47','1D40','1D48','1B1Z','1C12') AS prio
  FROM catalogue),
profiled AS (SELECT *, CASE
    WHEN rare_disease THEN 'rare'
    WHEN disease_code IN ('DA22.Z','DD70','DD71.Z') THEN 'general'
    WHEN disease_code IN ('CA23','CA22.Z','CA20.1','CA24','CA21.Y','CB03.4','MD31') THEN 'environmental_signal'
    WHEN type = 'epidemic_infectious' AND prio THEN 'high_priority'
    WHEN type = 'high_alert_notifiable' THEN 'high_priority'
    WHEN type = 'cancer_environmental_signal' THEN 'environmental_signal'
    WHEN disease_code IN ('1A00','1A07','1A09.0','1A02','1A06','1A31','1A36','1C1A.Z','1E50.0') OR type = 'gastrointestinal'
      OR regexp_matches(transmission_vector, 'waterborne|foodborne|fecal_oral') THEN 'cluster_sensitive'
    WHEN disease_code IN ('1E32','1C12','1B1Z','CA40.Z','CA41.Z','CA01') OR type = 'respiratory'
      OR regexp_matches(transmission_vector, 'airborne|droplet|respiratory|close_contact') THEN 'surge_sensitive'
    WHEN type = 'epidemic_infectious' AND (infection_score >= 0.75 OR risk_level >= 4) THEN 'high_priority'
    WHEN risk_level >= 5 AND infection_score >= 0.8 THEN 'high_priority'
    ELSE 'general' END AS policy_profile FROM marked),
classified AS (SELECT * EXCLUDE (prio), rare_disease OR prio OR policy_profile IN ('high_priority','rare') AS high_priority FROM profiled)"""


def policy_steps(diseases: str) -> str:
    return POLICY_TABLES + f""",
signalled AS (
  SELECT d.*, coalesce(a.canon, disease_code) AS canon,
    CASE WHEN infection_score <= 1 THEN greatest(infection_score, 0.0::DOUBLE) WHEN infection_score <= 5 THEN round(infection_score / 5.0, 3) ELSE 1.0 END::DOUBLE AS sig
  FROM {diseases} d LEFT JOIN alias a ON a.code = d.disease_code),
based AS (
  SELECT *, high_priority OR canon IN ('MEASLES','COVID','HFV','EBOLA','SARS','MERS','MPOX','RABIES','MENINGOCOCCAL','DENGUE','MALARIA',
      'YELLOW_FEVER','CHIKUNGUNYA','ZIKA','TUBERCULOSIS','PERTUSSIS') OR policy_profile IN ('high_priority','rare') OR (risk_level >= 5 AND sig >= 0.85) AS hp0,
    rare_disease OR canon IN ('POLIO','PLAGUE','SMALLPOX','EBOLA') OR policy_profile = 'rare' AS rare0
  FROM signalled),
policy AS (
  SELECT x.id AS disease_id, x.disease_code,
    coalesce(c.hp, p.hp, hp0) AS high_priority, coalesce(c.rare, p.rare, rare0) AS rare_disease,
    coalesce(c.l, p.l, 7)::INT AS lookback_days, coalesce(c.b, p.b, 7)::INT AS baseline_window_days,
    coalesce(c.r::DOUBLE, p.r::DOUBLE, 3.0::DOUBLE) AS radius_km,
    coalesce(c.sev::DOUBLE, p.sev::DOUBLE, round(1.0::DOUBLE + greatest(risk_level, 0)::DOUBLE * 0.15::DOUBLE + sig * 0.35::DOUBLE, 2)) AS severity_weight,
    coalesce(c.den::DOUBLE, p.den::DOUBLE, round(1.0::DOUBLE + greatest(sig - 0.4::DOUBLE, 0.0::DOUBLE) * 0.9::DOUBLE, 2)) AS density_weight,
    coalesce(c.tre::DOUBLE, p.tre::DOUBLE, round(1.0::DOUBLE + greatest(risk_level - 2, 0)::DOUBLE * 0.1::DOUBLE + CASE WHEN sig >= 0.75 THEN 0.15 ELSE 0.0 END::DOUBLE, 2)) AS trend_weight,
    coalesce(c.rar::DOUBLE, p.rar::DOUBLE, CASE WHEN rare0 THEN 3.0 ELSE 1.0 END::DOUBLE) AS rarity_weight,
    coalesce(c.clu, p.clu, CASE WHEN rare0 THEN 1 WHEN hp0 THEN 2 ELSE 3 END)::INT AS cluster_case_threshold,
    coalesce(c.cri, p.cri, CASE WHEN rare0 THEN 1 WHEN hp0 THEN 4 ELSE 6 END)::INT AS critical_case_threshold
  FROM based x LEFT JOIN profile_rule p ON p.key = x.policy_profile LEFT JOIN code_rule c ON c.key = x.canon)"""


STANDING = """
standing AS (
  SELECT r.* FROM report r WHERE status IN ('new','reviewed') AND alert_level IN ('medium','high','critical')
    AND (trigger_visit_id IS NULL OR trigger_visit_id IN (SELECT id FROM active)))"""

ANOMALY = f"""
windowed AS (SELECT * FROM visit WHERE diagnosis_date BETWEEN {NEWEST} - 30 AND {NEWEST}),
alive AS (SELECT * FROM (SELECT * FROM windowed QUALIFY row_number() OVER (PARTITION BY patient_id, disease_id ORDER BY diagnosis_date DESC, id DESC) = 1) WHERE status = 'infected'),
series AS (SELECT disease_id, region_type, diagnosis_date, count(DISTINCT visit_id) AS cases FROM alive a JOIN geodata g ON g.visit_id = a.id GROUP BY ALL),
spine AS (SELECT disease_id, region_type, unnest(generate_series(min(diagnosis_date), max(diagnosis_date), INTERVAL 1 DAY))::DATE AS diagnosis_date FROM series GROUP BY disease_id, region_type),
dense AS (SELECT s.*, coalesce(cases, 0) AS cases FROM spine s LEFT JOIN series USING (disease_id, region_type, diagnosis_date)),
rolled AS (SELECT *, row_number() OVER w AS pos, list(cases) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS base FROM dense WINDOW w AS (PARTITION BY disease_id, region_type ORDER BY diagnosis_date)),
stats AS (SELECT *, list_avg(base) AS mean, list_median(base)::DOUBLE AS med, list_max(base) AS highest FROM rolled WHERE pos > 7 AND cases > 0),
devs AS (SELECT *, list_median(list_transform(base, lambda v: abs(v - med)))::DOUBLE AS mad FROM stats),
scored AS (
  SELECT devs.*, d.disease_code, d.name AS disease_name, d.policy_profile, d.high_priority AS hp, d.rare_disease AS rare,
    CASE WHEN mean > 0 THEN round(cases / mean, 2) ELSE cases::DOUBLE END AS surge,
    round(greatest(CASE WHEN mad = 0 THEN cases - med ELSE 0.6745::DOUBLE * (cases - med) / mad END, 0.0::DOUBLE), 2) AS dev,
    CASE WHEN d.rare_disease THEN 1 WHEN d.high_priority OR d.policy_profile IN ('cluster_sensitive','surge_sensitive') THEN 2 ELSE 3 END AS need
  FROM devs JOIN disease d ON d.id = devs.disease_id),
final AS (
  SELECT *, round(least(100.0::DOUBLE,
      CASE WHEN mean = 0 AND cases >= need THEN least(cases * 10, 35)::DOUBLE ELSE least(greatest(cases - mean, 0.0::DOUBLE) * 12, 35.0::DOUBLE) END
      + CASE WHEN surge >= 2 THEN least((surge - 1.0::DOUBLE) * 18, 25.0::DOUBLE) ELSE 0 END
      + CASE WHEN dev >= 2 THEN least(dev * 6, 20.0::DOUBLE) ELSE 0 END
      + CASE WHEN hp THEN 10 ELSE 0 END + CASE WHEN rare THEN 20 ELSE 0 END), 2) AS anomaly_score FROM scored)"""

TREND = """
windows AS (SELECT DISTINCT disease_id, diagnosis_date AS e, lookback_days AS l, baseline_window_days AS b FROM visit JOIN policy USING (disease_id)),
bounds AS (
  SELECT disease_id, e, 'cur' AS kind, e - l AS s, e AS f FROM windows UNION ALL
  SELECT disease_id, e, 'prev', e - l - 1 - b, e - l - 1 FROM windows),
windowed AS (
  SELECT b.*, v.id, v.status, row_number() OVER (PARTITION BY b.disease_id, b.e, b.kind, v.patient_id ORDER BY v.diagnosis_date DESC, v.id DESC) AS rn
  FROM bounds b JOIN visit v ON v.disease_id = b.disease_id AND v.diagnosis_date BETWEEN b.s AND b.f),
in_force AS (SELECT disease_id, e, kind, id FROM windowed WHERE rn = 1 AND status = 'infected'),
counted AS (
  SELECT w.disease_id, w.e AS diagnosis_date, count(i.id) FILTER (kind = 'cur') AS current_count, count(i.id) FILTER (kind = 'prev') AS previous_count
  FROM windows w LEFT JOIN in_force i ON i.disease_id = w.disease_id AND i.e = w.e GROUP BY ALL),
trend AS (SELECT *,
    round(CASE WHEN previous_count > 0 THEN (current_count - previous_count)::DOUBLE / previous_count::DOUBLE WHEN current_count > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, 4) AS growth_rate,
    round(CASE WHEN previous_count > 0 THEN current_count::DOUBLE / previous_count::DOUBLE WHEN current_count > 0 THEN current_count ELSE 0 END::DOUBLE, 4) AS surge_ratio
  FROM counted)"""

REGION_TREND = TREND.split("counted AS (")[0].strip().rstrip(",") + """,
places AS (SELECT DISTINCT visit_id, region_type FROM geodata),
region_windows AS (SELECT DISTINCT w.*, region_type FROM windows w JOIN visit v ON v.disease_id = w.disease_id AND v.diagnosis_date = w.e JOIN places p ON p.visit_id = v.id),
counted AS (
  SELECT w.disease_id, w.region_type, w.e AS diagnosis_date, count(i.id) FILTER (kind = 'cur') AS current_count, count(i.id) FILTER (kind = 'prev') AS previous_count
  FROM region_windows w LEFT JOIN (SELECT * FROM in_force JOIN places ON visit_id = id) i ON i.disease_id = w.disease_id AND i.e = w.e AND i.region_type = w.region_type GROUP BY ALL),
trend AS (SELECT *,
    round(CASE WHEN previous_count > 0 THEN (current_count - previous_count)::DOUBLE / previous_count::DOUBLE WHEN current_count > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, 4) AS growth_rate,
    round(CASE WHEN previous_count > 0 THEN current_count::DOUBLE / previous_count::DOUBLE WHEN current_count > 0 THEN current_count ELSE 0 END::DOUBLE, 4) AS surge_ratio
  FROM counted)"""

HAVERSINE = """2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE,
  pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))"""


def nearby_steps(regional: bool) -> str:
    # The latest visit of each pair as seen from every context day, then all points in reach.
    same = "AND u.region_type = c.region_type" if regional else ""
    return f"""
alive AS (
  SELECT w.disease_id, w.e, v.id, v.status FROM windows w JOIN visit v
    ON v.disease_id = w.disease_id AND v.diagnosis_date BETWEEN w.e - w.l AND w.e
  QUALIFY row_number() OVER (PARTITION BY w.disease_id, w.e, v.patient_id ORDER BY v.diagnosis_date DESC, v.id DESC) = 1),
alive_points AS (
  SELECT a.disease_id, a.e, g.* FROM alive a JOIN geodata g ON g.visit_id = a.id WHERE a.status = 'infected'),
context AS (
  SELECT g.*, v.disease_id, v.diagnosis_date AS e, p.radius_km FROM geodata g JOIN visit v ON v.id = g.visit_id JOIN policy p ON p.disease_id = v.disease_id),
pairs AS (
  SELECT c.id AS geodata_id, u.visit_id AS case_visit_id, {HAVERSINE.format(a='c', b='u')} AS km
  FROM context c JOIN alive_points u ON u.disease_id = c.disease_id AND u.e = c.e AND u.visit_id <> c.visit_id {same}
    AND abs(u.latitude - c.latitude) < 0.2
  WHERE {HAVERSINE.format(a='c', b='u')} <= c.radius_km),
near AS (SELECT geodata_id, case_visit_id, min(round(km, 4)) AS distance_km FROM pairs GROUP BY ALL)"""


def outbreak_steps(regional: bool) -> list[str]:
    trend = REGION_TREND if regional else TREND
    join = "AND tr.region_type = g.region_type" if regional else ""
    return [
        policy_steps("disease"), trend, nearby_steps(regional),
        f"""base AS (
  SELECT g.id AS geodata_id, g.visit_id, v.diagnosis_date, p.*, tr.current_count, tr.previous_count, tr.growth_rate, tr.surge_ratio,
    g.visit_id IN (SELECT id FROM alive WHERE status = 'infected' AND e = v.diagnosis_date AND disease_id = v.disease_id) AS context_active,
    coalesce(n.c, 0) AS near_count
  FROM geodata g JOIN visit v ON v.id = g.visit_id JOIN policy p ON p.disease_id = v.disease_id
  JOIN trend tr ON tr.disease_id = v.disease_id AND tr.diagnosis_date = v.diagnosis_date {join}
  LEFT JOIN (SELECT geodata_id, count(*) AS c FROM near GROUP BY 1) n ON n.geodata_id = g.id),
located AS (SELECT *, CASE WHEN context_active THEN near_count ELSE 0 END AS nearby_case_count,
    CASE WHEN context_active THEN near_count + 1 ELSE 0 END AS local_case_count,
    CASE WHEN previous_count = 0 THEN current_count >= greatest(2, cluster_case_threshold) ELSE growth_rate >= 0.5 OR surge_ratio >= 1.5 END AS grows FROM base),
pointed AS (SELECT *,
    CASE WHEN context_active THEN 8 * severity_weight + CASE WHEN high_priority THEN 6 ELSE 0 END ELSE 0 END::DOUBLE AS sev,
    CASE WHEN context_active THEN 20 * density_weight * CASE WHEN local_case_count >= greatest(2, critical_case_threshold) THEN 1.0
      WHEN local_case_count >= cluster_case_threshold THEN 0.7 WHEN local_case_count > 1 THEN 0.35 WHEN high_priority THEN 0.15 ELSE 0.05 END::DOUBLE ELSE 0 END::DOUBLE AS den,
    CASE WHEN context_active THEN 16 * trend_weight * CASE
      WHEN previous_count = 0 THEN CASE WHEN current_count >= greatest(2, cluster_case_threshold) THEN 0.8 WHEN current_count > 0 THEN 0.2 ELSE 0 END
      WHEN surge_ratio >= 3 OR growth_rate >= 2 THEN 1.0 WHEN surge_ratio >= 2 OR growth_rate >= 1 THEN 0.75
      WHEN growth_rate >= 0.5 THEN 0.45 WHEN current_count > 0 THEN 0.1 ELSE 0 END::DOUBLE ELSE 0 END::DOUBLE AS tre,
    CASE WHEN context_active AND rare_disease THEN 20 * rarity_weight ELSE 0 END::DOUBLE AS rar FROM located),
total AS (SELECT *, round(least(100.0::DOUBLE, sev + den + tre + rar), 2) AS score FROM pointed),
levelled AS (SELECT *, CASE WHEN NOT context_active THEN 'no_alert'
    WHEN rare_disease AND current_count >= 1 THEN 'critical'
    WHEN local_case_count >= critical_case_threshold AND (high_priority OR current_count >= critical_case_threshold OR surge_ratio >= 2) THEN 'critical'
    WHEN score >= 80 THEN 'critical' WHEN high_priority AND local_case_count >= cluster_case_threshold THEN 'high'
    WHEN local_case_count >= cluster_case_threshold AND grows THEN 'high' WHEN score >= 55 THEN 'high'
    WHEN score >= 35 OR grows OR local_case_count > 1 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'no_alert' END AS level FROM total)""",
    ]


def outbreak_sql(regional: bool) -> str:
    return statement(
        """SELECT geodata_id, visit_id, disease_code, diagnosis_date, context_active, level AS alert_level, score, nearby_case_count,
  local_case_count, current_count, previous_count, growth_rate, surge_ratio, round(sev, 2) AS severity_points, round(den, 2) AS density_points,
  round(tre, 2) AS trend_points, round(rar, 2) AS rarity_points, level IN ('medium','high','critical') AS should_create_report,
  level IN ('high','critical') AND local_case_count >= greatest(2, cluster_case_threshold) AS should_create_cluster FROM levelled""",
        *outbreak_steps(regional),
    )


# The merge of results into the report table, one result after the other within a disease.
REPORT_FOLD = """
ana AS MATERIALIZED (SELECT disease_id, visit_id, diagnosis_date - lookback_days AS s, diagnosis_date AS f, CASE level WHEN 'no_alert' THEN 'low' ELSE level END AS lv, score AS sc, nearby_case_count::INT AS nb,
    current_count::INT AS cu, previous_count::INT AS pr, growth_rate AS gr, surge_ratio AS su, level IN ('medium','high','critical') AS flag, NOT context_active AND current_count = 0 AS quiet,
    row_number() OVER (PARTITION BY disease_id ORDER BY diagnosis_date, visit_id, geodata_id) AS n FROM levelled),
held AS MATERIALIZED (SELECT * FROM report WHERE disease_id IN (SELECT disease_id FROM ana) AND (status IN ('new','reviewed') OR trigger_visit_id IN (SELECT visit_id FROM ana))),
start AS (SELECT disease_id, list({'id': id::BIGINT, 't': trigger_visit_id::BIGINT, 's': analysis_period_start, 'f': analysis_period_end, 'lv': alert_level, 'sc': risk_score, 'nb': nearby_case_count, 'cu': current_case_count,
    'pr': previous_case_count, 'gr': growth_rate, 'su': surge_ratio, 'st': status, 'o': NULL::DATE} ORDER BY generated_at, id) AS held FROM held GROUP BY 1),
fold(disease_id, n, held) USING KEY (disease_id) AS (
  SELECT a.disease_id, 0::BIGINT, coalesce(any_value(held), []) FROM ana a LEFT JOIN start USING (disease_id) GROUP BY 1
  UNION ALL
  SELECT disease_id, n, CASE
      WHEN hit IS NULL AND flag THEN list_append(held, {'id': NULL::BIGINT, 't': visit_id::BIGINT, 's': s, 'f': f, 'lv': lv, 'sc': sc, 'nb': nb, 'cu': cu, 'pr': pr, 'gr': gr, 'su': su, 'st': 'new', 'o': f})
      WHEN hit IS NULL THEN held
      ELSE list_concat(held[:hit - 1], [{'id': r.id, 't': coalesce(r.t, visit_id), 's': least(r.s, s), 'f': greatest(r.f, f),
        'lv': CASE WHEN same OR rises OR (quiet AND NOT flag) THEN lv ELSE r.lv END, 'sc': CASE WHEN same OR rises OR (quiet AND NOT flag) THEN sc ELSE greatest(r.sc, sc) END,
        'nb': greatest(r.nb, nb), 'cu': greatest(r.cu, cu), 'pr': greatest(r.pr, pr), 'gr': greatest(r.gr, gr), 'su': greatest(r.su, su),
        'st': CASE WHEN flag THEN 'new' WHEN same OR quiet THEN 'resolved' ELSE r.st END, 'o': r.o}], held[hit + 1:]) END
  FROM (SELECT *, held[hit] AS r, coalesce(held[hit].t = visit_id, false) AS same,
      list_position(['low','medium','high','critical'], lv) >= list_position(['low','medium','high','critical'], held[hit].lv) AS rises
    FROM (SELECT a.*, x.held, coalesce(list_max(list_filter(range(1, len(x.held) + 1), lambda i: x.held[i].t = a.visit_id)),
          list_max(list_filter(range(1, len(x.held) + 1), lambda i: x.held[i].st IN ('new','reviewed') AND x.held[i].f >= a.s - 1 AND x.held[i].s <= a.f + 1))) AS hit
      FROM fold x JOIN ana a ON a.disease_id = x.disease_id AND a.n = x.n + 1))),
merged AS (SELECT disease_id, unnest(held) AS r FROM fold)"""

REPORTS = """SELECT id, generated_at, disease_id, trigger_visit_id, analysis_period_start, analysis_period_end, alert_level, risk_score, nearby_case_count, current_case_count, previous_case_count, growth_rate, surge_ratio, status
FROM report WHERE id NOT IN (SELECT id FROM held)
UNION ALL SELECT coalesce(r.id, (SELECT coalesce(max(id), 0) FROM report) + row_number() OVER (PARTITION BY r.id IS NULL ORDER BY r.o, r.t)), coalesce(h.generated_at, TIMESTAMP '2024-01-31'), m.disease_id, r.t, r.s, r.f, r.lv, r.sc, r.nb, r.cu, r.pr, r.gr, r.su, r.st
FROM merged m LEFT JOIN held h ON h.id = r.id"""



EXPORT_ABNORMAL = """(contains(lower(result), 'abnormal') OR (NOT regexp_matches(lower(result), 'normal|negative|within range|within normal|not detected')
  AND regexp_matches(lower(result), 'abnormal|positive|high|low|reactive|detected|critical|elevated')))"""
RISK_ABNORMAL = """(contains(lower(result), 'abnormal') OR (NOT regexp_matches(lower(result), 'normal|negative|within range|not detected')
  AND regexp_matches(lower(result), 'high|low|positive|critical|detected|elevated')))"""


def per_visit(abnormal: str) -> str:
    return f"""
pts AS (SELECT visit_id, count(*) AS geodata_count, max((region_type = 'home')::INT) AS has_home, max((region_type = 'work')::INT) AS has_work,
    string_agg(DISTINCT region_type, ',' ORDER BY region_type) AS regions,
    arg_min(id, (region_type <> 'home')::INT::HUGEINT * 1000000000000 + id) AS pref FROM geodata GROUP BY 1),
pref AS (SELECT p.*, g.region_type, g.latitude, g.longitude FROM pts p JOIN geodata g ON g.id = p.pref),
labs AS (SELECT visit_id, count(*) AS labs, count(*) FILTER ({abnormal}) AS abnormal FROM lab_test GROUP BY 1),
reps AS (SELECT trigger_visit_id AS visit_id, count(*) FILTER (status IN ('new','reviewed') AND alert_level IN ('medium','high','critical')) AS active_reports,
    arg_max(id, (generated_at, id)) AS latest FROM report WHERE trigger_visit_id IS NOT NULL GROUP BY 1),
lastrep AS (SELECT reps.*, r.alert_level, r.status, r.risk_score FROM reps JOIN report r ON r.id = reps.latest),
age AS (SELECT v.id AS visit_id, year(diagnosis_date) - year(birth_date) - (strftime(diagnosis_date, '%m%d') < strftime(birth_date, '%m%d'))::INT AS years
  FROM visit v JOIN patient p ON p.id = v.patient_id)"""


RISK_FEATURES = [
    "disease_risk_level", "disease_infection_score", "disease_high_priority", "disease_rare", "patient_age_years", "bmi",
    "geodata_count", "has_home_geodata", "has_work_geodata", "total_lab_test_count", "abnormal_lab_test_count",
    "latest_report_risk_score", "active_report_count", "has_active_alert", "primary_region_home", "primary_region_work",
    "recent_cluster_distance_km", "hotspot_nearby", "profile_general", "profile_high_priority", "profile_rare",
    "profile_cluster_sensitive", "profile_surge_sensitive", "profile_environmental_signal",
]
NEAR_CLUSTER = HAVERSINE.format(a="p", b="c")
FEATURE_STEPS = f"""
spots AS (SELECT *, center_lat AS latitude, center_long AS longitude FROM geocluster QUALIFY row_number() OVER (PARTITION BY disease_id ORDER BY generated_at DESC, id DESC) <= 5),
reach AS (SELECT v.id AS visit_id, round(min({NEAR_CLUSTER}), 4) AS km, max(({NEAR_CLUSTER} <= greatest(c.radius, 3.0))::INT) AS hit
  FROM visit v JOIN pref p ON p.visit_id = v.id JOIN spots c ON c.disease_id = v.disease_id GROUP BY 1),
features AS (SELECT v.id AS visit_id, d.risk_level::DOUBLE AS disease_risk_level, d.infection_score::DOUBLE AS disease_infection_score, d.high_priority::INT::DOUBLE AS disease_high_priority,
    d.rare_disease::INT::DOUBLE AS disease_rare, age.years::DOUBLE AS patient_age_years, coalesce(round(weight / ((height / 100.0::DOUBLE) * (height / 100.0::DOUBLE)), 4), 0)::DOUBLE AS bmi,
    coalesce(p.geodata_count, 0)::DOUBLE AS geodata_count, coalesce(has_home, 0)::DOUBLE AS has_home_geodata, coalesce(has_work, 0)::DOUBLE AS has_work_geodata,
    coalesce(labs, 0)::DOUBLE AS total_lab_test_count, coalesce(abnormal, 0)::DOUBLE AS abnormal_lab_test_count, coalesce(r.risk_score, 0)::DOUBLE AS latest_report_risk_score,
    coalesce(active_reports, 0)::DOUBLE AS active_report_count, (coalesce(active_reports, 0) > 0)::INT::DOUBLE AS has_active_alert,
    (coalesce(p.region_type, '') = 'home')::INT::DOUBLE AS primary_region_home, (coalesce(p.region_type, '') = 'work')::INT::DOUBLE AS primary_region_work,
    coalesce(km, 0)::DOUBLE AS recent_cluster_distance_km, coalesce(hit, 0)::DOUBLE AS hotspot_nearby,
    {", ".join(f"(d.policy_profile = '{x}')::INT::DOUBLE AS profile_{x}" for x in ["general", "high_priority", "rare", "cluster_sensitive", "surge_sensitive", "environmental_signal"])}
  FROM visit v JOIN disease d ON d.id = v.disease_id JOIN age ON age.visit_id = v.id LEFT JOIN pref p ON p.visit_id = v.id LEFT JOIN labs l ON l.visit_id = v.id
  LEFT JOIN lastrep r ON r.visit_id = v.id LEFT JOIN reach ON reach.visit_id = v.id)"""


def label_steps() -> list[str]:
    engine = outbreak_sql(False)
    steps = engine[len("WITH ") + len(BASE.strip()) + 2 : engine.index("SELECT geodata_id, visit_id, disease_code")].strip()
    return [
        steps,
        per_visit(RISK_ABNORMAL),
        """worst AS (SELECT trigger_visit_id AS visit_id, max(list_position(['low','medium','high','critical'], alert_level)) AS w FROM report WHERE trigger_visit_id IS NOT NULL GROUP BY 1),
labelled AS (SELECT a.id AS visit_id, CASE WHEN w IS NOT NULL THEN (['low','medium','high','critical'])[w::INT] WHEN l.level IS NULL OR l.level = 'no_alert' THEN 'low' ELSE l.level END AS label,
    CASE WHEN w IS NOT NULL THEN 'report' WHEN l.level IS NOT NULL THEN 'engine' ELSE 'default' END AS label_source
  FROM active a LEFT JOIN worst ON worst.visit_id = a.id LEFT JOIN pref ON pref.visit_id = a.id LEFT JOIN levelled l ON l.geodata_id = pref.pref)""",
    ]


def centroid_steps() -> list[str]:
    names = ", ".join(f"'{f}'" for f in RISK_FEATURES)
    return label_steps() + [
        FEATURE_STEPS,
        f"""long AS (SELECT visit_id, label, label_source, unnest([{names}]) AS feature, unnest([{", ".join(RISK_FEATURES)}]) AS value FROM features JOIN labelled USING (visit_id)),
ranges AS (SELECT feature, min(value) AS feature_min, max(value) AS feature_max FROM long GROUP BY 1),
scaled AS (SELECT visit_id, label, feature, feature_min, feature_max, CASE WHEN feature_max = feature_min THEN 0 ELSE round((value - feature_min) / (feature_max - feature_min), 6) END AS x FROM long JOIN ranges USING (feature)),
centroids AS (SELECT label, count(*) AS label_count, feature, round(avg(x), 6) AS centroid, feature_min, feature_max FROM scaled GROUP BY label, feature, feature_min, feature_max)""",
    ]


DBSCAN = f"""
pts AS MATERIALIZED (SELECT g.id, g.visit_id, g.patient_id, a.disease_id, a.diagnosis_date, g.latitude, g.longitude, g.region_type,
    row_number() OVER (PARTITION BY a.disease_id ORDER BY a.diagnosis_date, g.id) AS pos
  FROM active a JOIN geodata g ON g.visit_id = a.id WHERE a.diagnosis_date BETWEEN {NEWEST} - 14 AND {NEWEST}),
nb AS MATERIALIZED (SELECT p.disease_id, p.pos, q.pos AS other FROM pts p JOIN pts q ON p.disease_id = q.disease_id AND abs(p.latitude - q.latitude) < 0.02 WHERE {HAVERSINE.format(a='p', b='q')} <= 1.0),
core AS MATERIALIZED (SELECT disease_id, pos FROM nb GROUP BY 1, 2 HAVING count(*) >= 3),
link AS MATERIALIZED (SELECT nb.disease_id, nb.pos, nb.other FROM nb JOIN core c ON c.disease_id = nb.disease_id AND c.pos = nb.pos JOIN core d ON d.disease_id = nb.disease_id AND d.pos = nb.other),
walk(disease_id, pos, other) AS (SELECT disease_id, pos, other FROM link UNION SELECT w.disease_id, w.pos, l.other FROM walk w JOIN link l ON l.disease_id = w.disease_id AND l.pos = w.other),
rooted AS (SELECT disease_id, pos, min(other) AS root FROM walk GROUP BY 1, 2),
labelled AS (SELECT nb.disease_id, nb.pos, min(r.root) FILTER (nb.pos = nb.other) AS own, min(r.root) AS adjacent FROM nb JOIN rooted r ON r.disease_id = nb.disease_id AND r.pos = nb.other GROUP BY 1, 2),
clustered AS (SELECT p.*, f.id AS cluster_id FROM labelled l JOIN pts p ON p.disease_id = l.disease_id AND p.pos = l.pos JOIN pts f ON f.disease_id = l.disease_id AND f.pos = coalesce(own, adjacent))"""


TOTALS = """
totals AS (SELECT disease_id, cluster_id, count(*) AS point_count, count(DISTINCT visit_id) AS unique_visit_count, count(DISTINCT patient_id) AS unique_patient_count, avg(latitude) AS lat, avg(longitude) AS lon,
  min(diagnosis_date) AS diagnosis_start, max(diagnosis_date) AS diagnosis_end, string_agg(DISTINCT region_type, ',' ORDER BY region_type) AS region_types FROM clustered GROUP BY 1, 2)"""

SUMMARY = f"""SELECT t.disease_id, t.cluster_id, d.disease_code, point_count, unique_visit_count, unique_patient_count, round(lat, 6) AS center_lat, round(lon, 6) AS center_long,
  round(greatest(km, 0.1::DOUBLE), 4) AS radius_km, CASE WHEN d.rare_disease THEN 5 WHEN d.high_priority AND point_count >= 2 THEN greatest(4, least(5, d.risk_level)) WHEN point_count >= 6 THEN 5
    WHEN point_count >= 4 THEN greatest(4, least(5, d.risk_level)) ELSE greatest(2, least(5, d.risk_level)) END AS risk_level, diagnosis_start, diagnosis_end, region_types
FROM totals t JOIN disease d ON d.id = t.disease_id JOIN (SELECT c.cluster_id, max({HAVERSINE.format(a='m', b='c')}) AS km FROM clustered c JOIN (SELECT cluster_id, lat AS latitude, lon AS longitude FROM totals) m ON m.cluster_id = c.cluster_id GROUP BY 1) r ON r.cluster_id = t.cluster_id"""

# The merge of clusters into the hotspot table, one candidate after the other within a disease. Text
# formatting rounds the exact value, as the fold does.
def hotspot_fold(candidates: str) -> str:
    return candidates + f""",
live AS (SELECT disease_id, list({{'id': id::BIGINT, 'latitude': center_lat, 'longitude': center_long, 'radius': radius, 'cases': case_count, 'risk': risk_level, 'o': NULL::BIGINT[]}} ORDER BY generated_at, id) AS spots
  FROM geocluster WHERE generated_at >= TIMESTAMP '2024-01-01' GROUP BY 1),
merging(disease_id, n, spots) USING KEY (disease_id) AS (
  SELECT c.disease_id, 0::BIGINT, coalesce(any_value(spots), []) FROM cand c LEFT JOIN live l ON l.disease_id = c.disease_id GROUP BY 1
  UNION ALL
  SELECT disease_id, n, CASE WHEN hit IS NULL
      THEN list_append(spots, {{'id': NULL::BIGINT, 'latitude': format('{{:.6f}}', center_lat)::DOUBLE, 'longitude': format('{{:.6f}}', center_long)::DOUBLE, 'radius': format('{{:.4f}}', greatest(radius_km, 0.1))::DOUBLE, 'cases': cnt, 'risk': risk_level, 'o': o}})
      ELSE list_transform(spots, lambda s, i: CASE WHEN i <> hit THEN s ELSE {{'id': s.id,
        'latitude': format('{{:.6f}}', (s.latitude + center_lat) / 2)::DOUBLE, 'longitude': format('{{:.6f}}', (s.longitude + center_long) / 2)::DOUBLE,
        'radius': format('{{:.4f}}', greatest(s.radius, radius_km, 0.1))::DOUBLE, 'cases': greatest(s.cases, cnt), 'risk': greatest(s.risk, risk_level), 'o': s.o}} END) END
  FROM (SELECT f.disease_id, c.n, f.spots, c.center_lat, c.center_long, c.radius_km, c.cnt::INT AS cnt, c.risk_level::INT AS risk_level, c.o,
      list_max(list_filter(range(1, len(f.spots) + 1), lambda i: {HAVERSINE.format(a="{'latitude': c.place_lat, 'longitude': c.place_long}", b="f.spots[i]")} <= greatest(f.spots[i].radius, c.reach))) AS hit
    FROM merging f JOIN cand c ON c.disease_id = f.disease_id AND c.n = f.n + 1)),
spots AS (SELECT disease_id, unnest(spots) AS s FROM merging)"""


CLUSTER_CANDIDATES = f"""
summary AS MATERIALIZED ({SUMMARY}),
cand AS MATERIALIZED (SELECT *, center_lat AS place_lat, center_long AS place_long, unique_visit_count AS cnt, greatest(radius_km, 3.0::DOUBLE) AS reach, [-risk_level, -point_count, cluster_id]::BIGINT[] AS o,
    row_number() OVER (PARTITION BY disease_id ORDER BY risk_level DESC, point_count DESC, cluster_id) AS n FROM summary)"""

CALL_CANDIDATES = """
cand AS MATERIALIZED (SELECT disease_id, c.latitude AS place_lat, c.longitude AS place_long, m.latitude AS center_lat, m.longitude AS center_long, km AS radius_km, 3.0::DOUBLE AS reach, local_case_count AS cnt,
    CASE level WHEN 'high' THEN 4 ELSE 5 END AS risk_level, [diagnosis_date - DATE '1970-01-01', visit_id, c.geodata_id]::BIGINT[] AS o, row_number() OVER (PARTITION BY disease_id ORDER BY diagnosis_date, visit_id, c.geodata_id) AS n
  FROM called c JOIN middle m ON m.geodata_id = c.geodata_id JOIN wide w ON w.geodata_id = c.geodata_id)"""

HOTSPOTS = """SELECT g.id, coalesce(s.latitude, center_lat) AS center_lat, coalesce(s.longitude, center_long) AS center_long, coalesce(s.radius, g.radius) AS radius, g.disease_id,
  coalesce(s.cases, case_count) AS case_count, coalesce(s.risk, risk_level) AS risk_level, generated_at FROM geocluster g LEFT JOIN spots m ON m.s.id = g.id
UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM geocluster) + row_number() OVER (ORDER BY s.o, disease_id), s.latitude, s.longitude, s.radius, disease_id, s.cases, s.risk, TIMESTAMP '2024-01-31' FROM spots WHERE s.id IS NULL"""


GENERATED = """
located AS (SELECT * FROM visit WHERE diagnosis_date >= DATE '2024-01-16' AND id IN (SELECT visit_id FROM geodata WHERE region_type = 'home')),
periods AS (SELECT disease_id, DATE '2024-01-16' AS s, max(diagnosis_date) AS f, greatest(max(diagnosis_date) - DATE '2024-01-16', 1)::INT AS days FROM located GROUP BY 1),
cur AS (SELECT p.disease_id, v.id, v.status FROM periods p JOIN visit v ON v.disease_id = p.disease_id AND v.diagnosis_date BETWEEN s AND f
  QUALIFY row_number() OVER (PARTITION BY v.patient_id, v.disease_id ORDER BY diagnosis_date DESC, id DESC) = 1),
prev AS (SELECT p.disease_id, v.id, v.status FROM periods p JOIN visit v ON v.disease_id = p.disease_id AND v.diagnosis_date BETWEEN s - 1 - days AND s - 1
  QUALIFY row_number() OVER (PARTITION BY v.patient_id, v.disease_id ORDER BY diagnosis_date DESC, id DESC) = 1),
two AS (SELECT p.*, (SELECT count(*) FROM cur WHERE cur.disease_id = p.disease_id AND status = 'infected' AND id IN (SELECT visit_id FROM geodata WHERE region_type = 'home')) AS c,
  (SELECT count(*) FROM prev WHERE prev.disease_id = p.disease_id AND status = 'infected' AND id IN (SELECT visit_id FROM geodata WHERE region_type = 'home')) AS p FROM periods p),
rated AS (SELECT two.*, c * d.infection_score * d.risk_level AS risk_score,
  round(CASE WHEN p > 0 THEN (c - p)::DOUBLE / p::DOUBLE WHEN c > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, 4) AS growth_rate,
  round(CASE WHEN p > 0 THEN c::DOUBLE / p::DOUBLE WHEN c > 0 THEN c ELSE 0 END::DOUBLE, 4) AS surge_ratio FROM two JOIN disease d ON d.id = two.disease_id)"""

# A defect of each kind at every n-th key, and the rules stated once more.
SPOILED = """
people AS (SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN 'x' ELSE gender END AS gender, CASE WHEN id % 11 = 0 THEN 91 ELSE residence_lat END AS residence_lat, CASE WHEN id % 13 = 0 THEN NULL ELSE residence_long END AS residence_long,
    CASE WHEN id % 17 = 0 THEN NULL ELSE coalesce(work_lat, residence_lat) END AS work_lat, CASE WHEN id % 19 = 0 THEN -180.5 ELSE coalesce(work_long, residence_long) END AS work_long,
    CASE WHEN id % 23 = 0 THEN DATE '2030-01-01' ELSE birth_date END AS birth_date, CASE WHEN id % 29 = 0 THEN '  ' ELSE name END AS name, CASE WHEN id % 31 = 0 THEN '' ELSE national_number END AS national_number) FROM patient),
listed AS (SELECT id, CASE WHEN id % 7 = 0 THEN 6 ELSE risk_level END AS risk_level, CASE WHEN id % 11 = 0 THEN -0.5 ELSE infection_score END AS infection_score, CASE WHEN id % 13 = 0 THEN 'none' ELSE policy_profile END AS policy_profile,
    CASE WHEN id % 17 = 0 THEN ' ' WHEN id % 23 = 0 THEN lower(disease_code) ELSE disease_code END AS disease_code, CASE WHEN id % 19 = 0 THEN '' ELSE name END AS name FROM classified),
rules AS (
  SELECT 'users' AS table_name, 'role' AS rule, count(*) AS violations FROM users WHERE id % 7 = 0
  UNION ALL SELECT 'hospital', unnest(['hospital_lat', 'hospital_long']), unnest([count(*) FILTER (id % 7 = 0), count(*) FILTER (id % 11 = 0)]) FROM hospital
  UNION ALL SELECT 'patient', unnest(['gender', 'residence_lat', 'residence_long', 'work_lat', 'work_long', 'residence_pair', 'work_pair', 'birth_date', 'name', 'national_number']), unnest([
    count(*) FILTER (gender NOT IN ('male', 'female')), count(*) FILTER (abs(residence_lat) > 90), count(*) FILTER (abs(residence_long) > 180), count(*) FILTER (abs(work_lat) > 90), count(*) FILTER (abs(work_long) > 180),
    count(*) FILTER ((residence_lat IS NULL) <> (residence_long IS NULL)), count(*) FILTER ((work_lat IS NULL) <> (work_long IS NULL)), count(*) FILTER (birth_date > DATE '2024-06-01'), count(*) FILTER (trim(name) = ''), count(*) FILTER (trim(national_number) = '')]) FROM people
  UNION ALL SELECT 'disease', unnest(['risk_level', 'infection_score', 'policy_profile', 'disease_code', 'code_not_upper', 'name']), unnest([count(*) FILTER (risk_level NOT BETWEEN 0 AND 5), count(*) FILTER (infection_score < 0),
    count(*) FILTER (policy_profile NOT IN ('general', 'high_priority', 'rare', 'cluster_sensitive', 'surge_sensitive', 'environmental_signal')), count(*) FILTER (trim(disease_code) = ''), count(*) FILTER (disease_code <> upper(trim(disease_code))), count(*) FILTER (trim(name) = '')]) FROM listed
  UNION ALL SELECT 'visit', unnest(['status', 'marital_status', 'weight', 'height', 'before_birth']), unnest([count(*) FILTER (v.id % 7 = 0 OR v.status NOT IN ('infected', 'cured')), count(*) FILTER (v.id % 11 = 0), count(*) FILTER (v.id % 13 = 0), count(*) FILTER (v.id % 17 = 0), count(*) FILTER (diagnosis_date < birth_date)])
    FROM visit v LEFT JOIN people p ON p.id = v.patient_id
  UNION ALL SELECT 'geodata', unnest(['region_type', 'latitude', 'longitude', 'patient']), unnest([count(*) FILTER (id % 7 = 0), count(*) FILTER (id % 11 = 0), count(*) FILTER (id % 13 = 0), count(*) FILTER (id % 17 = 0)]) FROM geodata
  UNION ALL SELECT 'geocluster', unnest(['center_lat', 'center_long', 'radius', 'case_count', 'risk_level']), unnest([count(*) FILTER (id % 7 = 0), count(*) FILTER (id % 11 = 0), count(*) FILTER (id % 13 = 0), count(*) FILTER (id % 17 = 0), count(*) FILTER (id % 19 = 0)]) FROM geocluster
  UNION ALL SELECT 'report', unnest(['alert_level', 'status', 'period', 'trigger_visit', 'nearby_case_count', 'current_case_count', 'previous_case_count']), unnest([count(*) FILTER (r.id % 7 = 0), count(*) FILTER (r.id % 11 = 0),
    count(*) FILTER (r.id % 13 = 0 OR analysis_period_start > analysis_period_end), count(*) FILTER (v.disease_id <> CASE WHEN r.id % 17 = 0 THEN 99 ELSE r.disease_id END), count(*) FILTER (r.id % 19 = 0), count(*) FILTER (r.id % 23 = 0), count(*) FILTER (r.id % 29 = 0)])
    FROM report r LEFT JOIN visit v ON v.id = r.trigger_visit_id)"""

# Wording of reasons and summaries.
TOLD = """
told AS (SELECT l.*, d.name AS disease_name, CASE WHEN NOT context_active THEN 'Latest patient+disease visit is not infected.' ELSE concat_ws(' ',
    CASE WHEN l.rare_disease THEN 'Rare-disease policy is active.' END, CASE WHEN l.high_priority THEN 'High-priority disease policy is active.' END,
    CASE WHEN nearby_case_count > 0 THEN nearby_case_count || ' nearby case(s) matched within ' || radius_km || ' km.' END,
    CASE WHEN local_case_count >= cluster_case_threshold THEN 'Local case count reached the cluster threshold (' || cluster_case_threshold || ').' END,
    CASE WHEN local_case_count >= critical_case_threshold THEN 'Local case count reached the critical threshold (' || critical_case_threshold || ').' END,
    CASE WHEN previous_count = 0 AND current_count > 0 THEN 'New activity detected without a previous baseline.' WHEN surge_ratio >= 2 THEN 'Temporal surge detected with ratio ' || surge_ratio || '.'
      WHEN growth_rate >= 0.5 THEN 'Case growth rate reached ' || growth_rate || '.' END) END AS reasons FROM levelled l JOIN disease d ON d.id = l.disease_id)"""

CALLED = f"""
called AS (SELECT l.*, g.latitude, g.longitude FROM levelled l JOIN geodata g ON g.id = l.geodata_id WHERE level IN ('high','critical') AND local_case_count >= greatest(2, cluster_case_threshold)),
spread AS (SELECT geodata_id, latitude, longitude FROM called UNION ALL SELECT n.geodata_id, g.latitude, g.longitude FROM near n JOIN called c ON c.geodata_id = n.geodata_id JOIN geodata g ON g.visit_id = n.case_visit_id),
middle AS (SELECT geodata_id, sum(latitude::DECIMAL(18,12))::DOUBLE / count(*) AS latitude, sum(longitude::DECIMAL(18,12))::DOUBLE / count(*) AS longitude FROM spread GROUP BY 1),
wide AS (SELECT s.geodata_id, max({HAVERSINE.format(a='m', b='s')}) AS km FROM spread s JOIN middle m ON m.geodata_id = s.geodata_id GROUP BY 1)"""


FEED = """
saved AS (SELECT g.id AS seq, g.id AS geodata_id, g.visit_id, g.patient_id, v.disease_id, v.doctor_id, v.diagnosis_date, v.status FROM geodata g JOIN visit v ON v.id = g.visit_id),
stood AS (SELECT s.*, s.visit_id = (max((diagnosis_date, visit_id)) OVER (PARTITION BY patient_id, disease_id ORDER BY seq))[2] AS latest FROM saved s),
feed AS (
  SELECT seq, CASE WHEN latest AND status = 'infected' THEN 'case.added' ELSE 'case.removed' END AS event_type, geodata_id, visit_id, patient_id, disease_id, doctor_id, diagnosis_date, status FROM stood
  UNION ALL SELECT n.seq, 'case.removed', o.geodata_id, o.visit_id, o.patient_id, o.disease_id, o.doctor_id, o.diagnosis_date, o.status
  FROM stood n JOIN saved o ON o.patient_id = n.patient_id AND o.disease_id = n.disease_id AND o.seq < n.seq AND o.visit_id <> n.visit_id WHERE n.latest)"""


def dq_sql() -> str:
    checks = [
        ("users", "role", "users", "role NOT IN ('admin','doctor')"),
        ("report", "period", "report", "analysis_period_start > analysis_period_end"),
        ("report", "trigger_visit", "report r JOIN visit v ON v.id = r.trigger_visit_id", "v.disease_id <> r.disease_id"),
        ("visit", "weight", "visit", "weight < 0.1 OR weight > 500"),
        ("visit", "height", "visit", "height < 30 OR height > 250"),
        ("visit", "before_birth", "visit v JOIN patient p ON p.id = v.patient_id", "diagnosis_date < birth_date"),
        ("patient", "residence_lat", "patient", "residence_lat NOT BETWEEN -90 AND 90"),
        ("patient", "work_pair", "patient", "(work_lat IS NULL) <> (work_long IS NULL)"),
        ("geodata", "patient", "geodata g JOIN visit v ON v.id = g.visit_id", "g.patient_id <> v.patient_id"),
        ("geocluster", "risk_level", "geocluster", "risk_level NOT BETWEEN 0 AND 5"),
        ("disease", "infection_score", "disease", "infection_score < 0"),
        ("catalogue", "risk_level", "classified", "risk_level NOT BETWEEN 0 AND 5"),
    ]
    parts = [f"SELECT '{a}' AS table_name, '{b}' AS rule, count(*) AS violations FROM {c} WHERE {d} HAVING count(*) > 0" for a, b, c, d in checks]
    return statement(" UNION ALL ".join(parts), CLASSIFIED)


def oracle_sql() -> dict[str, str]:
    window14 = f"windowed AS (SELECT * FROM visit WHERE diagnosis_date BETWEEN {NEWEST} - 14 AND {NEWEST})"
    sql = {
        "cases_by_disease": statement("SELECT d.id AS disease_id, d.name AS disease_name, count(*) AS total_cases FROM visit v JOIN disease d ON d.id = v.disease_id GROUP BY 1, 2"),
        "cases_over_time": statement("SELECT diagnosis_date, count(*) AS total_cases FROM visit GROUP BY 1"),
        "cases_by_doctor": statement("SELECT v.doctor_id, u.username AS doctor_username, count(*) AS total_cases FROM visit v JOIN doctor d ON d.id = v.doctor_id JOIN users u ON u.id = d.user_id GROUP BY 1, 2"),
        "cases_by_region_type": statement("SELECT region_type, count(DISTINCT visit_id) AS total_cases FROM geodata GROUP BY 1"),
        "disease_region_matrix": statement("SELECT d.name AS disease_name, g.region_type, count(DISTINCT g.visit_id) AS total_cases FROM geodata g JOIN visit v ON v.id = g.visit_id JOIN disease d ON d.id = v.disease_id GROUP BY 1, 2"),
        "active_visits_global": statement("SELECT id, patient_id, disease_id, diagnosis_date FROM active"),
        "active_visits_window": statement(
            "SELECT id, patient_id, disease_id, diagnosis_date FROM (SELECT * FROM windowed QUALIFY row_number() OVER (PARTITION BY patient_id, disease_id ORDER BY diagnosis_date DESC, id DESC) = 1) WHERE status = 'infected'", window14),
        "visit_activity": statement("SELECT disease_id, id IN (SELECT id FROM active) AS is_active, count(*) AS visits FROM visit GROUP BY 1, 2"),
        "active_points_case_mode": statement(
            f"SELECT min(g.id) AS geodata_id, visit_id, disease_id, diagnosis_date, min_by(region_type, g.id) AS region_type FROM active a JOIN geodata g ON g.visit_id = a.id WHERE diagnosis_date BETWEEN {NEWEST} - 14 AND {NEWEST} GROUP BY 2, 3, 4"),
        "active_point_list": statement(
            "SELECT g.id AS geodata_id, g.visit_id, g.patient_id, a.diagnosis_date FROM active a JOIN geodata g ON g.visit_id = a.id JOIN doctor d ON d.id = a.doctor_id WHERE g.region_type = 'home' AND hospital_id = 3 AND disease_id = 2 AND diagnosis_date >= DATE '2024-01-05'"),
        "map_active_cases": statement(MAP_SELECT.format(visits="active", where="", page="")),
        "map_page": statement(MAP_SELECT.format(visits="active", where="", page="ORDER BY v.diagnosis_date, g.id LIMIT 500")),
        "map_historical_cases": statement(MAP_SELECT.format(visits="visit", where="WHERE upper(disease_code) = 'MEA' AND diagnosis_date >= DATE '2024-01-05' AND region_type = 'work' AND status = 'infected'", page="")),
        "map_hospital_cases": statement(MAP_SELECT.format(visits="active", where="WHERE upper(type) = 'VIRAL' AND doc.hospital_id = 3", page="")),
        "patient_scope": statement("SELECT p.id, p.national_number FROM patient p WHERE id NOT IN (SELECT patient_id FROM visit) OR id IN (SELECT patient_id FROM visit v JOIN doctor d ON d.id = v.doctor_id WHERE hospital_id = 3)"),
        "hospital_scope": statement("""SELECT 'visit' AS table_name, count(*) AS visible_rows FROM seen UNION ALL SELECT 'geodata', count(*) FROM geodata WHERE visit_id IN (SELECT id FROM seen)
UNION ALL SELECT 'lab_test', count(*) FROM lab_test WHERE visit_id IN (SELECT id FROM seen) UNION ALL SELECT 'doctor', count(*) FROM doctor WHERE hospital_id = 3 UNION ALL SELECT 'hospital', count(*) FROM hospital WHERE id = 3""",
            "seen AS (SELECT v.id FROM visit v JOIN doctor d ON d.id = v.doctor_id WHERE hospital_id = 3)"),
        "active_alerts": statement("SELECT id, disease_id, trigger_visit_id, alert_level, status, risk_score FROM standing WHERE risk_score >= 20", STANDING),
        "active_hotspots": statement("SELECT id, disease_id, risk_level, case_count, generated_at FROM geocluster WHERE risk_level >= 2 AND case_count >= 3"),
        "alerts_by_disease": statement("SELECT d.id AS disease_id, d.name AS disease_name, d.disease_code, count(*) AS alert_count, max(s.risk_score) AS max_risk_score FROM standing s JOIN disease d ON d.id = s.disease_id GROUP BY 1, 2, 3", STANDING),
        "dashboard_summary": statement("""SELECT count(*) AS active_alert_count, count(*) FILTER (alert_level = 'critical') AS critical_alert_count, count(*) FILTER (alert_level = 'high') AS high_alert_count,
  count(*) FILTER (alert_level = 'medium') AS medium_alert_count, count(*) FILTER (status = 'new') AS new_alert_count, count(*) FILTER (status = 'reviewed') AS reviewed_alert_count,
  (SELECT count(*) FROM geocluster WHERE risk_level >= 2) AS active_hotspot_count, (SELECT count(*) FROM active) AS active_case_count,
  (SELECT id FROM standing ORDER BY risk_score DESC, generated_at DESC, id DESC LIMIT 1) AS top_alert_id, (SELECT max(risk_score) FROM standing) AS top_alert_risk_score,
  (SELECT id FROM geocluster WHERE risk_level >= 2 ORDER BY risk_level DESC, case_count DESC, generated_at DESC, id DESC LIMIT 1) AS top_hotspot_id,
  (SELECT max(risk_level) FROM geocluster WHERE risk_level >= 2) AS top_hotspot_risk_level FROM standing""", STANDING),
        "patient_history": statement("""SELECT v.id, v.patient_id, v.disease_id, v.diagnosis_date, v.status, v.doctor_id, u.username, u.real_name, d.specialization, d.hospital_id, h.name AS hospital_name
FROM visit v JOIN doctor d ON d.id = v.doctor_id JOIN users u ON u.id = d.user_id JOIN hospital h ON h.id = d.hospital_id"""),
        "visit_page": statement("SELECT id, patient_id, doctor_id, diagnosis_date, status FROM visit WHERE disease_id = 4 AND diagnosis_date <= DATE '2024-01-25' ORDER BY diagnosis_date DESC, id DESC LIMIT 100 OFFSET 100"),
        "anomalies": statement("""SELECT disease_id, disease_code, disease_name, policy_profile, region_type, diagnosis_date AS target_date, diagnosis_date - 7 AS baseline_start, diagnosis_date - 1 AS baseline_end,
  cases AS observed_count, round(mean, 2) AS baseline_mean, round(med, 2) AS baseline_median, highest AS baseline_max, surge AS surge_ratio, dev AS deviation_score, anomaly_score, severity
FROM (SELECT *, CASE WHEN (rare AND anomaly_score >= 25) OR anomaly_score >= 80 THEN 'critical' WHEN anomaly_score >= 55 THEN 'high' WHEN anomaly_score >= 35 THEN 'medium' ELSE 'low' END AS severity FROM final)
WHERE severity <> 'low' AND (rare OR (cases >= need AND (mean = 0 OR surge >= 2 OR dev >= 3 OR cases >= highest + 2)))""", ANOMALY),
        "disease_classification": statement("SELECT id, disease_code, policy_profile, high_priority, rare_disease FROM classified", CLASSIFIED),
        "alert_policies": statement("SELECT * FROM policy", CLASSIFIED, policy_steps("classified")),
        "trend_snapshots": statement("SELECT * FROM trend", policy_steps("disease"), TREND),
        "trend_snapshots_by_region": statement("SELECT * FROM trend", policy_steps("disease"), REGION_TREND),
        "nearby_cases": statement("SELECT geodata_id, case_visit_id, v.diagnosis_date AS case_date, distance_km FROM near JOIN visit v ON v.id = case_visit_id",
                                  policy_steps("disease"), TREND, nearby_steps(False)),
        "report_merge": statement(REPORTS, *outbreak_steps(False), REPORT_FOLD, recursive=True),
        "outbreak_evaluation": outbreak_sql(False),
        "exposure_evaluation": outbreak_sql(True),
        "generated_reports": statement("""SELECT disease_id, s AS analysis_period_start, f AS analysis_period_end,
  CASE WHEN risk_score >= 80 OR c >= 6 OR surge_ratio >= 2.5 THEN 'critical' WHEN risk_score >= 45 OR c >= 3 OR surge_ratio >= 1.5 THEN 'high' WHEN risk_score >= 20 OR c >= 1 THEN 'medium' ELSE 'low' END AS alert_level,
  risk_score, 0 AS nearby_case_count, c AS current_case_count, p AS previous_case_count, growth_rate, surge_ratio, 'new' AS status FROM rated""",
            GENERATED),
    }
    sql |= {
        "dq_every_rule": statement("SELECT * FROM rules WHERE violations > 0", CLASSIFIED, SPOILED),
        "outbreak_texts": statement("""SELECT geodata_id, reasons, 'Outbreak analysis for ' || disease_name || ' reached alert level ' || level || '. Risk score: ' || score || '. Current vs previous cases: ' || current_count || ' / ' || previous_count || '.'
    || CASE WHEN reasons <> '' THEN ' Reasons: ' || reasons ELSE '' END AS summary FROM told""", *outbreak_steps(False), TOLD),
        "anomaly_texts": statement("""SELECT disease_id, region_type, diagnosis_date AS target_date, concat_ws(' ', 'Observed ' || cases || ' case(s) against a baseline mean of ' || round(mean, 2) || '.', CASE WHEN surge >= 2 THEN 'Surge ratio reached ' || surge || '.' END,
  CASE WHEN dev >= 3 THEN 'Deviation score reached ' || dev || '.' END, CASE WHEN rare THEN 'Rare-disease profile increases anomaly sensitivity.' WHEN hp THEN 'High-priority disease profile increases anomaly sensitivity.' END) AS reasons
FROM final WHERE ((rare AND anomaly_score >= 25) OR anomaly_score >= 35) AND (rare OR (cases >= need AND (mean = 0 OR surge >= 2 OR dev >= 3 OR cases >= highest + 2)))""", ANOMALY),
        "report_texts": statement("""SELECT r.disease_id, concat_ws(' ', 'Report generated for disease ' || d.name || '.', 'Current period captured ' || c || ' case(s).', 'Region type filter applied: home.',
  CASE WHEN p = 0 AND c > 0 THEN 'Current period has no previous baseline cases.' WHEN surge_ratio >= 1.5 THEN 'Temporal surge ratio reached ' || surge_ratio || '.' WHEN growth_rate > 0 THEN 'Growth rate reached ' || growth_rate || '.' END) AS reasons,
  'Disease ' || d.name || ' recorded ' || c || ' case(s) between ' || s || ' and ' || f || ' with alert level ' || CASE WHEN risk_score >= 80 OR c >= 6 OR surge_ratio >= 2.5 THEN 'critical' WHEN risk_score >= 45 OR c >= 3 OR surge_ratio >= 1.5 THEN 'high' WHEN risk_score >= 20 OR c >= 1 THEN 'medium' ELSE 'low' END || '.' AS summary
FROM rated r JOIN disease d ON d.id = r.disease_id""", GENERATED),
        "visit_evaluation": outbreak_sql(True) + "\nWHERE geodata_id IN (SELECT min(id) FROM geodata WHERE region_type = 'work' GROUP BY visit_id)",
        "cluster_from_analysis": statement("""SELECT disease_id, c.latitude AS place_lat, c.longitude AS place_long, round(m.latitude, 6) AS center_lat, round(m.longitude, 6) AS center_long, round(km, 4) AS radius_km, 3.0::DOUBLE AS reach_km, local_case_count::INT AS case_count,
  CASE level WHEN 'high' THEN 4 ELSE 5 END::INT AS risk_level, (diagnosis_date - DATE '1970-01-01')::BIGINT AS o1, visit_id AS o2, c.geodata_id AS o3 FROM called c JOIN middle m ON m.geodata_id = c.geodata_id JOIN wide w ON w.geodata_id = c.geodata_id""", *outbreak_steps(False), CALLED),
        "dq_violations": dq_sql(),
        "duplicate_keys": statement("""SELECT 'disease_code' AS rule, disease_code AS key_value, count(*) AS occurrences FROM classified GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'national_number', national_number, count(*) FROM patient GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'email', lower(email), count(*) FROM users WHERE email <> '' GROUP BY 2 HAVING count(*) > 1""", CLASSIFIED),
        "geodata_derivation": statement("""SELECT o.o_custkey AS patient_id, o.o_orderkey AS visit_id, p.lat AS latitude, p.lon AS longitude, p.region_type FROM orders o JOIN (
  SELECT id, residence_lat AS lat, residence_long AS lon, 'home' AS region_type FROM patient UNION ALL SELECT id, work_lat, work_long, 'work' FROM patient) p ON p.id = o.o_custkey
WHERE p.lat BETWEEN -90 AND 90 AND p.lon BETWEEN -180 AND 180 AND NOT EXISTS (SELECT 1 FROM geodata g WHERE g.visit_id = o.o_orderkey AND g.region_type = p.region_type)"""),
        "upsert_diseases": statement("""SELECT d.id, coalesce(n.disease_code, d.disease_code) AS disease_code, coalesce(n.name, d.name) AS name, coalesce(n.type, d.type) AS type,
  coalesce(n.transmission_vector, d.transmission_vector) AS transmission_vector, coalesce(n.risk_level, d.risk_level) AS risk_level, coalesce(n.infection_score, d.infection_score)::DOUBLE AS infection_score,
  coalesce(n.policy_profile, d.policy_profile) AS policy_profile, coalesce(n.high_priority, d.high_priority) AS high_priority, coalesce(n.rare_disease, d.rare_disease) AS rare_disease,
  CASE WHEN n.disease_code IS NULL THEN 'kept' WHEN d.disease_code IS NULL THEN 'created' ELSE 'updated' END AS change
FROM disease d FULL JOIN (SELECT * FROM classified QUALIFY row_number() OVER (PARTITION BY disease_code ORDER BY id DESC) = 1) n ON n.disease_code = d.disease_code""", CLASSIFIED),
        "fk_missing": statement("""SELECT DISTINCT 'patient_id' AS reference, l_partkey AS missing_id FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM patient)
UNION ALL SELECT DISTINCT 'doctor_id', l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT id FROM doctor) UNION ALL SELECT DISTINCT 'disease_id', l_linenumber::BIGINT FROM lineitem WHERE l_linenumber NOT IN (SELECT id FROM disease)"""),
        "import_hospitals": """SELECT row_number() OVER (ORDER BY s_suppkey) AS row_number, NOT bad AS accepted, CASE WHEN bad THEN concat_ws('; ', text, 'coordinates are out of range')
    ELSE concat_ws('|', row_number() OVER (ORDER BY s_suppkey), CASE WHEN s_suppkey % 4 = 0 THEN 'Hospital ' || row_number() OVER (ORDER BY s_suppkey) ELSE 'Clinic "' || s_suppkey || '", north' || chr(10) || 'wing' END, (s_suppkey % 90) || '.0', '36.25', 'street ' || s_suppkey, 'town') END AS content
  FROM (SELECT s_suppkey, s_suppkey % 9 = 0 OR s_suppkey % 10 = 0 OR s_suppkey % 11 = 0 AS bad, CASE WHEN s_suppkey % 9 = 0 OR s_suppkey % 10 = 0 THEN 'latitude is not a number' END AS text FROM supplier)""",
        "import_users": """SELECT row_number() OVER (ORDER BY c_custkey) AS row_number, number IS NULL AND role IS NOT NULL AS accepted, CASE WHEN number IS NOT NULL OR role IS NULL THEN concat_ws('; ', number, CASE WHEN role IS NULL THEN 'role is not in the domain' END)
    ELSE concat_ws('|', c_custkey, 'user' || c_custkey, 'u' || c_custkey || '@example.org', 'A', 'B, C', 'say "hi"', '01234567890123456789', role, 'true', 'true', 'true') END AS content
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'id is not a number' END AS number, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'doctor' WHEN c_custkey % 3 = 0 THEN 'admin' ELSE 'doctor' END AS role FROM customer)""",
        "import_doctors": """SELECT row_number() OVER (ORDER BY p_partkey) AS row_number, p_partkey % 17 <> 0 AS accepted, CASE WHEN p_partkey % 17 = 0 THEN 'user_id is not a number'
    ELSE concat_ws('|', p_partkey, p_partkey * 2, 'Internal' || chr(9) || 'Medicine', CASE WHEN p_size BETWEEN 1 AND 20 OR p_size > 24 THEN 'preferred' ELSE 'known' END) END AS content FROM part""",
        "import_patients": """SELECT row_number() OVER (ORDER BY c_custkey) AS row_number, reasons = '' AS accepted, CASE WHEN reasons <> '' THEN reasons ELSE concat_ws('|', c_custkey, c_name, '"' || c_custkey || '"' || chr(10) || ', last', '1980-12-31',
      CASE WHEN c_custkey % 5 = 0 THEN 'female' ELSE 'male' END, CASE WHEN c_custkey % 4 = 0 THEN '-' ELSE '33.5' END, CASE WHEN c_custkey % 4 = 0 THEN '-' ELSE '36.5' END, '33.25', '36.25') END AS content
  FROM (SELECT c_custkey, c_name, concat_ws('; ', CASE WHEN c_custkey % 8 = 0 OR c_custkey % 9 = 0 THEN 'birth_date is not a date' END, CASE WHEN c_custkey % 11 = 0 THEN 'work_lat is not a number' END,
      CASE WHEN c_custkey % 6 = 0 THEN 'gender is not in the domain' END, CASE WHEN c_custkey % 7 = 0 THEN 'residence_lat is out of range' END, CASE WHEN c_custkey % 10 = 0 THEN 'work_long is out of range' END) AS reasons FROM customer)""",
        "import_visits": """SELECT row_number, reasons = '' AS accepted, CASE WHEN reasons <> '' THEN reasons ELSE concat_ws('|', k, o_custkey, 3, k % 5 + 1, '', '2024-01-05', CASE WHEN k % 5 = 0 THEN 'cured' ELSE 'infected' END, '70.5', '170.0',
      CASE WHEN k % 3 = 0 THEN 'widow' WHEN k % 2 = 0 THEN 'divorced' ELSE 'single' END) END AS content
  FROM (SELECT o_orderkey AS k, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS row_number, concat_ws('; ', CASE WHEN o_orderkey % 19 = 0 THEN 'doctor_id is not a number' END, CASE WHEN o_orderkey % 8 = 0 OR o_orderkey % 9 = 0 THEN 'diagnosis_date is not an ISO date' END,
      CASE WHEN o_orderkey % 10 = 0 THEN 'weight is missing or not a number' END, CASE WHEN o_orderkey % 10 <> 0 AND o_orderkey % 11 = 0 THEN 'weight is out of range' END, CASE WHEN o_orderkey % 14 = 0 THEN 'height is out of range' END,
      CASE WHEN o_orderkey % 12 = 0 THEN 'status is not in the domain' END, CASE WHEN o_orderkey % 16 = 0 THEN 'marital_status is not in the domain' END) AS reasons FROM orders)""",
        "import_diseases": """SELECT row_number() OVER (ORDER BY p_partkey) AS row_number, 'X' || p_partkey AS disease_code, 'Fever; "' || p_partkey || '"' AS name, 'viral' AS type, 'a' || chr(10) || 'b' AS symptoms,
    CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 6 END::INT AS risk_level, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS infection_score, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey END::INT AS source_record_id, 'listed' AS source_name FROM part""",
        "visit_import_plan": statement("""SELECT 'insert' AS action, count(*) AS visits FROM orders WHERE o_orderkey NOT IN (SELECT id FROM visit) UNION ALL SELECT 'replay', count(*) FROM orders WHERE o_orderkey IN (SELECT id FROM visit) UNION ALL SELECT 'skip', 0"""),
        "hospital_repair": statement("SELECT true AS known, count(*) AS doctors FROM part"),
        "value_fixes": statement("""SELECT id, CASE WHEN segment IN ('admin','doctor') THEN segment ELSE 'doctor' END AS role, CASE WHEN w IN ('female','f','أنثى','انثى') THEN 'female' ELSE 'male' END AS gender,
  CASE WHEN w IN ('cured','recovered','recovery','healed','شفاء','متعافي') THEN 'cured' ELSE 'infected' END AS status, CASE WHEN w IN ('work','office','job','عمل') THEN 'work' ELSE 'home' END AS region_type,
  CASE WHEN w IN ('divorced','مطلق','مطلقة') THEN 'divorced' WHEN w IN ('married','متزوج','متزوجة') THEN 'married' WHEN w IN ('widow(er)','widow','widower','widowed','ارمل','أرمل','ارملة','أرملة') THEN 'widow' ELSE 'single' END AS marital_status,
  left(trim(word), 3) AS short_word, CASE w WHEN 'divorce' THEN 'divorced' WHEN 'widow(er)' THEN 'widow' ELSE w END AS imported_marital, id = 1 AS truth FROM words""",
            """words AS (SELECT c_custkey AS id, lower(c_mktsegment) AS segment, word, lower(trim(word)) AS w FROM (SELECT *,
  (['F',' Female ','m','أنثى','Recovered','شفاء','office','عمل','Widow(er)','متزوج','divorced',''])[(c_custkey % 12 + 1)::INT] AS word FROM customer))"""),
        "merge_histories": statement("""SELECT k.id, k.patient_id, k.flag AS has_surgical_metal_plates, coalesce(n, 0) AS vaccines FROM
  (SELECT c_custkey // 3 AS patient_id, min(c_custkey) AS id, bool_or(c_acctbal > 9000) AS flag FROM customer GROUP BY 1) k
  LEFT JOIN (SELECT o_custkey // 3 AS patient_id, count(*) AS n FROM orders GROUP BY 1) o ON o.patient_id = k.patient_id"""),
        "visit_level_dataset": statement("""SELECT v.id AS visit_id, v.diagnosis_date, v.patient_id, pa.gender AS patient_gender, age.years AS patient_age_years, v.doctor_id, doc.hospital_id, h.city AS hospital_city,
  v.disease_id, d.disease_code, d.name AS disease_name, d.type AS disease_type, d.policy_profile, d.risk_level AS disease_risk_level, d.infection_score::DOUBLE AS disease_infection_score,
  d.high_priority::INT AS disease_high_priority, d.rare_disease::INT AS disease_rare, v.status AS visit_status, v.marital_status, v.weight, v.height,
  round(weight / ((height / 100.0::DOUBLE) * (height / 100.0::DOUBLE)), 2) AS bmi, p.region_type AS primary_region_type, round(p.latitude, 4) AS primary_latitude, round(p.longitude, 4) AS primary_longitude,
  coalesce(geodata_count, 0) AS geodata_count, coalesce(has_home, 0) AS has_home_geodata, coalesce(has_work, 0) AS has_work_geodata, coalesce(regions, '') AS available_region_types,
  coalesce(labs, 0) AS total_lab_test_count, coalesce(abnormal, 0) AS abnormal_lab_test_count, r.alert_level AS latest_report_alert_level, r.status AS latest_report_status, r.risk_score AS latest_report_risk_score,
  coalesce(active_reports, 0) AS active_report_count, (coalesce(active_reports, 0) > 0)::INT AS has_active_alert
FROM visit v JOIN patient pa ON pa.id = v.patient_id JOIN age ON age.visit_id = v.id JOIN doctor doc ON doc.id = v.doctor_id JOIN hospital h ON h.id = doc.hospital_id JOIN disease d ON d.id = v.disease_id
LEFT JOIN pref p ON p.visit_id = v.id LEFT JOIN labs l ON l.visit_id = v.id LEFT JOIN lastrep r ON r.visit_id = v.id""", per_visit(EXPORT_ABNORMAL)),
        "disease_region_day_dataset": statement("""SELECT g.*, d.disease_code, d.name AS disease_name, d.type AS disease_type, d.policy_profile, d.high_priority::INT AS disease_high_priority, d.rare_disease::INT AS disease_rare,
  (coalesce(n, 0) * visit_count)::BIGINT AS active_report_count, (coalesce(cr, 0) * visit_count)::BIGINT AS critical_alert_count, (coalesce(hi, 0) * visit_count)::BIGINT AS high_alert_count, (coalesce(me, 0) * visit_count)::BIGINT AS medium_alert_count,
  greatest(coalesce(risk, 0), 0)::DOUBLE AS max_report_risk_score, (SELECT count(*) FROM geocluster c WHERE c.disease_id = g.disease_id AND risk_level >= 2) AS active_hotspot_count
FROM grouped g JOIN disease d ON d.id = g.disease_id LEFT JOIN days USING (disease_id, diagnosis_date)""", per_visit(EXPORT_ABNORMAL),
            """placed AS (SELECT v.id, v.patient_id, v.doctor_id, v.disease_id, v.diagnosis_date, coalesce(g.region_type, 'unknown') AS region_type, count(g.id) AS pts, sum(g.latitude) AS lat, sum(g.longitude) AS lon FROM visit v LEFT JOIN geodata g ON g.visit_id = v.id GROUP BY ALL),
grouped AS (SELECT diagnosis_date, disease_id, region_type, count(*) AS visit_count, count(DISTINCT patient_id) AS unique_patient_count, count(DISTINCT doctor_id) AS doctor_count, count(DISTINCT hospital_id) AS hospital_count,
  round(sum(lat) / sum(pts), 4) AS avg_latitude, round(sum(lon) / sum(pts), 4) AS avg_longitude, coalesce(sum(labs), 0)::BIGINT AS total_lab_test_count, coalesce(sum(abnormal), 0)::BIGINT AS abnormal_lab_test_count
  FROM placed p JOIN doctor doc ON doc.id = p.doctor_id LEFT JOIN labs ON labs.visit_id = p.id GROUP BY 1, 2, 3),
days AS (SELECT v.disease_id, v.diagnosis_date, count(*) AS n, count(*) FILTER (alert_level = 'critical') AS cr, count(*) FILTER (alert_level = 'high') AS hi, count(*) FILTER (alert_level = 'medium') AS me, max(risk_score) AS risk
  FROM (SELECT DISTINCT disease_id, diagnosis_date FROM visit) v JOIN report r ON r.disease_id = v.disease_id AND v.diagnosis_date BETWEEN analysis_period_start AND analysis_period_end
  WHERE status IN ('new','reviewed') AND alert_level IN ('medium','high','critical') GROUP BY 1, 2)"""),
        "risk_features": statement("SELECT * FROM features", per_visit(RISK_ABNORMAL), FEATURE_STEPS),
        "risk_labels": statement("SELECT * FROM labelled", *label_steps()),
        "risk_centroids": statement("SELECT * FROM centroids", *centroid_steps()),
        "risk_predictions": statement("""SELECT f.visit_id, CASE WHEN a.id IS NULL THEN 'low' ELSE label END AS predicted_label, CASE WHEN a.id IS NULL THEN 1.0 ELSE round((1.0::DOUBLE / (dist + 1e-6::DOUBLE)) / whole, 4) END::DOUBLE AS confidence,
  CASE WHEN a.id IS NULL THEN 'inactive_status' WHEN w IS NOT NULL THEN 'report' END AS label_source
FROM features f LEFT JOIN active a ON a.id = f.visit_id LEFT JOIN worst ON worst.visit_id = f.visit_id JOIN best ON best.visit_id = f.visit_id""", *centroid_steps(),
            f"""every AS (SELECT visit_id, unnest([{", ".join(f"'{f}'" for f in RISK_FEATURES)}]) AS feature, unnest([{", ".join(RISK_FEATURES)}]) AS value FROM features),
dists AS (SELECT visit_id, label, round(sqrt(sum(pow(CASE WHEN feature_max = feature_min THEN 0 ELSE round((value - feature_min) / (feature_max - feature_min), 6) END - centroid, 2))), 6) AS dist FROM every JOIN centroids USING (feature) GROUP BY 1, 2),
best AS (SELECT visit_id, arg_min(label, (dist, list_position(['low','medium','high','critical'], label))) AS label, min(dist) AS dist, sum(1.0::DOUBLE / (dist + 1e-6::DOUBLE)) AS whole FROM dists GROUP BY 1)"""),
        "case_events": statement("SELECT seq, event_type, geodata_id, visit_id, patient_id, disease_id, status FROM feed", FEED),
        "case_event_routing": statement("""SELECT group_name, event_type, count(*) AS events FROM (SELECT event_type, unnest(['map.active.all', 'map.active.disease.' || upper(disease_code), 'map.active.type.' || lower(d.type)]) AS group_name
FROM feed f JOIN disease d ON d.id = f.disease_id JOIN doctor doc ON doc.id = f.doctor_id WHERE hospital_id = 3 AND diagnosis_date >= DATE '2024-01-10') GROUP BY 1, 2""", FEED),
        "dbscan_labels": statement("SELECT id AS geodata_id, disease_id, cluster_id FROM clustered", DBSCAN, recursive=True),
        "dbscan_summary": statement(SUMMARY, DBSCAN, TOTALS, recursive=True),
        "hotspot_merge": statement(HOTSPOTS, DBSCAN, TOTALS, hotspot_fold(CLUSTER_CANDIDATES), recursive=True),
        "forest_samples": statement("""SELECT r.id AS report_id, alert_level AS label, nearby_case_count::DOUBLE AS nearby_case_count, current_case_count::DOUBLE AS current_case_count, previous_case_count::DOUBLE AS previous_case_count,
  growth_rate, surge_ratio, risk_score AS rule_based_risk_score, d.risk_level::DOUBLE AS disease_risk_level, d.infection_score::DOUBLE AS infection_score, d.high_priority::INT::DOUBLE AS high_priority, d.rare_disease::INT::DOUBLE AS rare_disease,
  0.0::DOUBLE AS hdbscan_cluster_detected, 0.0::DOUBLE AS hdbscan_cluster_size, 0.0::DOUBLE AS hdbscan_cluster_probability, 0.0::DOUBLE AS hdbscan_cluster_radius_km FROM report r JOIN disease d ON d.id = r.disease_id"""),
    }
    sql["stored_centroids"] = sql["risk_centroids"]
    sql["exported_visits"] = f"""SELECT visit_id::VARCHAR AS visit_id, diagnosis_date::VARCHAR AS diagnosis_date, patient_id::VARCHAR AS patient_id, disease_code, patient_age_years::VARCHAR AS patient_age_years,
  primary_region_type, latest_report_alert_level, total_lab_test_count::VARCHAR AS total_lab_test_count, has_active_alert::VARCHAR AS has_active_alert FROM ({sql['visit_level_dataset']})"""
    sql["geojson_features"] = f"""SELECT m.geodata_id, 'Feature' AS kind, 'Point' AS shape, g.longitude, g.latitude, m.geodata_id AS property_id, m.visit_id, m.disease_code, m.region_type, NULL::DOUBLE AS latitude_property
  FROM ({sql['map_active_cases']}) m JOIN ({statement('SELECT id, longitude, latitude FROM geodata')}) g ON g.id = m.geodata_id"""
    sql["label_counts"] = statement("SELECT label, label_source, count(*) AS samples FROM labelled l WHERE visit_id IN (SELECT id FROM active) GROUP BY 1, 2", *label_steps())
    sql["monitor_stream"] = statement(f"SELECT *, 'report' AS table_name FROM ({REPORTS}) UNION ALL BY NAME SELECT *, 'geocluster' AS table_name FROM ({HOTSPOTS})",
                                      *outbreak_steps(False), REPORT_FOLD, CALLED, hotspot_fold(CALL_CANDIDATES), recursive=True)
    return sql
