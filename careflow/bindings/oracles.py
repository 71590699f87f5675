"""The same queries in plain SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

import re

S, E = "DATE '1998-01-05'", "DATE '1998-05-05'"
FIRST_LAST = "DATE '1998-01-22'"  # last day of the first of 7 segments of 120 days

CTES: dict[str, str] = {
    "episodes": """
SELECT l_orderkey*10+l_linenumber AS episode_id, l_suppkey+1 AS facility_id,
  CAST(100+c_nationkey AS BIGINT) AS area_id, CAST(100+s_nationkey AS BIGINT) AS facility_area_id,
  CAST(n_regionkey+1 AS BIGINT) AS region_id, l_partkey AS diagnosis_code, l_returnflag AS procedure_code,
  CAST(o_orderdate AS DATE) AS admit_date,
  CAST(o_orderdate AS DATE)+CAST(l_quantity AS INT) AS discharge_date, CAST(l_quantity AS INT) AS stay_days
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
  JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON c_nationkey=n_nationkey""",
    "diagnoses": """
SELECT p_partkey AS code,
  CASE WHEN p_type='PROMO' THEN 'CANCER' WHEN p_brand='Brand#2' THEN 'COVID' ELSE 'OTHER' END AS disease,
  CASE WHEN p_type='PROMO' THEN 'CANCER' ELSE 'OTHER' END AS disease_coarse
FROM part""",
    "procedures": "SELECT * FROM (VALUES ('R','SURGERY'),('A','CLINICAL')) t(code, treatment)",
    "cls": """
SELECT e.*, COALESCE(disease,'OTHER')||'_'||COALESCE(treatment,'CLINICAL') AS patient_type,
  COALESCE(disease_coarse,'OTHER')||'_'||COALESCE(treatment,'CLINICAL') AS patient_type_coarse
FROM episodes e LEFT JOIN diagnoses d ON e.diagnosis_code=d.code LEFT JOIN procedures p ON e.procedure_code=p.code""",
    "months": "SELECT DISTINCT CAST(year(o_orderdate)*100+month(o_orderdate) AS INT) AS month_key FROM orders",
    "bed_rows": """
SELECT s_suppkey+1 AS facility_id, bed_code, bed_kind, month_key,
  CAST((s_suppkey*13+month_key*7+bed_code*5) % 40 AS BIGINT) AS qty
FROM supplier CROSS JOIN months CROSS JOIN (VALUES (12,1),(44,2),(3,1),(33,2),(99,2)) t(bed_code, bed_kind)""",
    "bed_lookup": """
SELECT * FROM (VALUES (12,'CANCER_SURGERY'),(44,'CANCER_CLINICAL'),(3,'OTHER_SURGERY'),(33,'OTHER_CLINICAL'))
  t(code, bed_group)""",
    "beds_cls": "SELECT b.*, bed_group FROM bed_rows b LEFT JOIN bed_lookup ON bed_code=code",
    "staff_rows": """
SELECT s_suppkey+1 AS facility_id, month_key, k AS occupation_code, CAST((s_suppkey+k*7) % 21 AS INT) AS h_amb,
  CAST((s_suppkey*3+month_key+k) % 41 AS INT) AS h_hosp, CAST(k*2 AS INT) AS h_other
FROM supplier CROSS JOIN months CROSS JOIN (VALUES (1),(2),(3)) o(k)""",
    "staff_cls": """
SELECT facility_id, COALESCE(name,'Outros') AS occupation, month_key,
  CAST(trunc((h_amb+h_hosp+h_other)/5) AS BIGINT) AS hours, COUNT(occupation_code) AS headcount
FROM staff_rows LEFT JOIN (VALUES (1,'Physician'),(2,'Nurse')) t(code,name) ON occupation_code=code
GROUP BY ALL""",
    "coords": """
SELECT CAST(floor(code_full/10) AS BIGINT) AS area_id, lat, lon FROM (
  SELECT (100+n_nationkey)*10 + n_nationkey % 10 AS code_full, CAST(-33+(n_nationkey*7)%38 AS DOUBLE) AS lat,
    CAST(-73+(n_nationkey*11)%38 AS DOUBLE) AS lon FROM nation)""",
    "hav": """
SELECT o.area_id, d.area_id AS facility_area_id,
  6373.0*2*atan2(sqrt(pow(sin(radians(d.lat-o.lat)/2),2)+cos(radians(o.lat))*cos(radians(d.lat))*pow(sin(radians(d.lon-o.lon)/2),2)),
    sqrt(1-(pow(sin(radians(d.lat-o.lat)/2),2)+cos(radians(o.lat))*cos(radians(d.lat))*pow(sin(radians(d.lon-o.lon)/2),2)))) AS raw_km
FROM coords o CROSS JOIN coords d""",
    "area_km": """
SELECT area_id, facility_area_id, CASE WHEN raw_km=0 THEN 1.0 ELSE raw_km END AS km FROM hav
WHERE area_id IN (SELECT area_id FROM episodes) AND facility_area_id IN (SELECT facility_area_id FROM episodes)""",
    "facility_km": """
SELECT area_id, facility_id, min(km) AS km
FROM area_km LEFT JOIN (SELECT DISTINCT facility_id, facility_area_id FROM episodes) USING (facility_area_id)
GROUP BY ALL""",
    "od_all": """
SELECT area_id, facility_id, km FROM facility_km
UNION ALL SELECT DISTINCT area_id, 0, 99999.9 FROM facility_km""",
    "daily_cancer": """
SELECT admit_date AS date, area_id, patient_type, COUNT(episode_id) AS qty FROM cls
WHERE admit_date >= DATE '1996-01-01' AND admit_date < DATE '1997-03-01' AND patient_type LIKE 'CANCER%' GROUP BY ALL""",
    "daily_region": """
SELECT admit_date AS date, region_id AS area_id, patient_type, COUNT(episode_id) AS qty FROM cls
WHERE admit_date >= DATE '1996-01-01' AND admit_date < DATE '1997-03-01' GROUP BY ALL""",
    "plan_days": f"SELECT CAST(d AS DATE) AS date FROM generate_series({S}, {E}, INTERVAL 1 DAY) t(d)",
    "model_days": f"SELECT date FROM plan_days WHERE date < {E}",
    "profile_region": """
SELECT area_id, patient_type, weekday, qty/n AS qty FROM (
  SELECT area_id, patient_type, isodow(date)-1 AS weekday, SUM(qty) AS qty FROM daily_region GROUP BY ALL)
JOIN (SELECT isodow(date)-1 AS weekday, COUNT(DISTINCT date) AS n FROM daily_region GROUP BY ALL) USING (weekday)""",
    "profile_cancer": """
SELECT area_id, patient_type, weekday, qty/n AS qty FROM (
  SELECT area_id, patient_type, isodow(date)-1 AS weekday, SUM(qty) AS qty FROM daily_cancer GROUP BY ALL)
JOIN (SELECT isodow(date)-1 AS weekday, COUNT(DISTINCT date) AS n FROM daily_cancer GROUP BY ALL) USING (weekday)""",
    "projected_region": """
SELECT date, area_id, patient_type, qty FROM plan_days JOIN profile_region ON isodow(date)-1=weekday""",
    "projected_cancer": """
SELECT date, area_id, patient_type, qty FROM plan_days JOIN profile_cancer ON isodow(date)-1=weekday""",
    "whole_region": """
SELECT date, area_id, patient_type, CAST(round_even(qty,0) AS BIGINT) AS qty FROM projected_region WHERE qty >= 1
UNION ALL SELECT date, area_id, patient_type, 1 FROM (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|','7',date,area_id,patient_type)), date, area_id, patient_type) AS rn
  FROM projected_region WHERE qty < 1)
WHERE rn <= (SELECT CAST(round_even(SUM(qty),0) AS BIGINT) FROM projected_region WHERE qty < 1)""",
    "demand": """
SELECT date, area_id, patient_type, CAST(round_even(qty,0) AS BIGINT) AS qty FROM projected_cancer WHERE qty >= 1
UNION ALL SELECT date, area_id, patient_type, 1 FROM (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|','7',date,area_id,patient_type)), date, area_id, patient_type) AS rn
  FROM projected_cancer WHERE qty < 1)
WHERE rn <= (SELECT CAST(round_even(SUM(qty),0) AS BIGINT) FROM projected_cancer WHERE qty < 1)""",
    "demand_of_11": """
SELECT date, area_id, patient_type, CAST(round_even(qty,0) AS BIGINT) AS qty FROM projected_cancer
WHERE qty >= 1 AND CAST(area_id AS VARCHAR) LIKE '11%'
UNION ALL SELECT date, area_id, patient_type, 1 FROM (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|','7',date,area_id,patient_type)), date, area_id, patient_type) AS rn
  FROM projected_cancer WHERE qty < 1 AND CAST(area_id AS VARCHAR) LIKE '11%')
WHERE rn <= (SELECT CAST(round_even(SUM(qty),0) AS BIGINT) FROM projected_cancer WHERE qty < 1)""",
    "flows": """
SELECT admit_date AS date, area_id, patient_type, COUNT(episode_id) AS qty FROM cls GROUP BY ALL""",
    "los_all": f"""
SELECT patient_type, CAST(round_even(avg(stay_days),0) AS BIGINT) AS los FROM cls
WHERE patient_type IN (SELECT patient_type FROM cls WHERE admit_date >= {S} AND admit_date < {E}) GROUP BY ALL""",
    "los": "SELECT * FROM los_all WHERE patient_type LIKE 'CANCER%'",
}


def _ledger(prefix: str, source: str, col: str) -> None:
    """Key union, two left joins, running sum, dense cross product and forward fill."""
    CTES[f"{prefix}_mov"] = f"""
SELECT k.patient_type, k.facility_id, k.date, COALESCE(a.n,0) AS admits, COALESCE(b.n,0) AS discharges FROM (
  SELECT {col} AS patient_type, facility_id, admit_date AS date FROM {source}
  UNION SELECT {col}, facility_id, discharge_date FROM {source}) k
LEFT JOIN (SELECT {col} AS patient_type, facility_id, admit_date AS date, COUNT(episode_id) AS n FROM {source} GROUP BY ALL) a
  USING (patient_type, facility_id, date)
LEFT JOIN (SELECT {col} AS patient_type, facility_id, discharge_date AS date, COUNT(episode_id) AS n FROM {source} GROUP BY ALL) b
  USING (patient_type, facility_id, date)
WHERE a.n IS NOT NULL OR b.n IS NOT NULL"""
    CTES[f"{prefix}_sparse"] = f"""
SELECT *, admits-discharges AS net,
  CAST(SUM(admits-discharges) OVER (PARTITION BY patient_type, facility_id ORDER BY date) AS BIGINT) AS census FROM {prefix}_mov"""
    CTES[f"{prefix}_rel"] = f"""
SELECT {col} AS patient_type, facility_id, discharge_date AS date, COUNT(episode_id) AS releases FROM {source}
WHERE admit_date < {S} AND discharge_date > {S} AND discharge_date < {E} GROUP BY ALL"""
    CTES[f"{prefix}_grid"] = f"""
SELECT * FROM (SELECT DISTINCT patient_type FROM {prefix}_mov) CROSS JOIN (SELECT DISTINCT facility_id FROM {prefix}_mov)
CROSS JOIN (SELECT DISTINCT date FROM {prefix}_mov)"""
    CTES[f"{prefix}_dense"] = f"""
SELECT date, facility_id, patient_type, COALESCE(admits,0) AS admits, COALESCE(discharges,0) AS discharges,
  COALESCE(net,0) AS net,
  COALESCE(last_value(census IGNORE NULLS) OVER (PARTITION BY patient_type, facility_id ORDER BY date),0) AS census,
  COALESCE(releases,0) AS releases
FROM {prefix}_grid LEFT JOIN {prefix}_sparse USING (patient_type, facility_id, date)
LEFT JOIN {prefix}_rel USING (patient_type, facility_id, date)"""
    CTES[f"{prefix}_ledger"] = f"SELECT * FROM {prefix}_dense WHERE date >= {S} AND date < {E}"


_ledger("fine", "cls", "patient_type")
_ledger("coarse", "cls", "patient_type_coarse")
_ledger("proc", "episodes", "procedure_code")


def _costs(prefix: str, weights: str) -> None:
    CTES[f"{prefix}weights"] = f"SELECT CAST(round(1-i*{weights},1) AS DOUBLE) AS weight FROM range(CAST(1/{weights} AS BIGINT)+1) t(i)"
    CTES[f"{prefix}costs"] = f"""
SELECT weight, u.area_id, facility_id, u.date,
  weight*km/(worst_distance-best_distance)
  + round(1-weight,1)*CAST(0.52 AS DOUBLE)*exposure/(worst_infection-best_infection) AS cost
FROM units u CROSS JOIN {prefix}weights CROSS JOIN bounds"""
    CTES[f"{prefix}plan"] = f"""
SELECT weight, patient_type, area_id, facility_id, date, qty FROM mdemand JOIN (
  SELECT * FROM {prefix}costs
  QUALIFY row_number() OVER (PARTITION BY weight, area_id, date ORDER BY cost, facility_id=0, facility_id) = 1) USING (area_id, date)"""
    CTES[f"{prefix}census"] = f"""
SELECT g.weight, g.patient_type, g.facility_id, g.date,
  CAST(COALESCE(any_value(i.census),0)
   + SUM(COALESCE(c.change,0)) OVER (PARTITION BY g.weight, g.patient_type, g.facility_id ORDER BY g.date) AS BIGINT) AS census
FROM (
  SELECT * FROM (
    SELECT DISTINCT weight, patient_type, facility_id FROM {prefix}plan
    UNION SELECT weight, patient_type, facility_id FROM {prefix}weights CROSS JOIN initial
    UNION SELECT weight, patient_type, facility_id FROM {prefix}weights CROSS JOIN releases WHERE date < {E}) s
  CROSS JOIN model_days) g
LEFT JOIN initial i USING (patient_type, facility_id)
LEFT JOIN (
  SELECT weight, patient_type, facility_id, date, SUM(change) AS change FROM (
    SELECT weight, patient_type, facility_id, date, qty AS change FROM {prefix}plan
    UNION ALL SELECT weight, patient_type, facility_id, date+CAST(los AS INT), -qty FROM {prefix}plan JOIN los USING (patient_type)
    UNION ALL SELECT weight, patient_type, facility_id, date, -releases FROM releases CROSS JOIN {prefix}weights) m
  GROUP BY ALL) c
  ON c.weight=g.weight AND c.patient_type=g.patient_type AND c.facility_id=g.facility_id AND c.date=g.date
GROUP BY g.weight, g.patient_type, g.facility_id, g.date, c.change"""


CTES |= {
    "peak": """
SELECT facility_id, patient_type, MAX(census) AS peak FROM coarse_dense WHERE patient_type LIKE 'CANCER%'
GROUP BY ALL HAVING MAX(census) > 0""",
    "other": """
SELECT date, facility_id, CAST(SUM(census) AS BIGINT) AS census FROM fine_ledger WHERE patient_type LIKE 'OTHER%'
GROUP BY ALL HAVING SUM(census) > 0""",
    "covid": """
SELECT date, facility_id, CAST(SUM(census) AS BIGINT) AS census FROM fine_ledger WHERE patient_type LIKE 'COVID%' GROUP BY ALL""",
    "covid_over": "SELECT * FROM covid UNION ALL SELECT DISTINCT date, 0, 999999 FROM covid",
    "infected": "SELECT date, facility_id, census FROM covid_over WHERE census > 0",
    "beds": """
SELECT DISTINCT facility_id, patient_type, date, beds FROM (
  SELECT facility_id, bed_group AS patient_type, month_key, CAST(SUM(qty) AS BIGINT) AS beds FROM beds_cls
  WHERE bed_group IS NOT NULL GROUP BY ALL)
JOIN plan_days ON year(date)*100+month(date)=month_key WHERE beds > 0""",
    "staff_days": """
SELECT facility_id, occupation, hours, headcount, date FROM staff_cls JOIN plan_days ON year(date)*100+month(date)=month_key
UNION ALL SELECT DISTINCT 0, 'Médico', 999999, 999999, date FROM staff_cls JOIN plan_days ON year(date)*100+month(date)=month_key""",
    "headcount": "SELECT facility_id, date, CAST(SUM(headcount) AS BIGINT) AS headcount FROM staff_days GROUP BY ALL",
    "hours": """
SELECT facility_id, date, CAST(ceil(SUM(q)/5) AS BIGINT) AS hours FROM (
  SELECT facility_id, date, hours*SUM(headcount) AS q FROM staff_days GROUP BY facility_id, date, hours) GROUP BY ALL""",
    "exposure": """
SELECT date, facility_id, headcount*census AS exposure FROM covid_over JOIN headcount USING (date, facility_id)
WHERE headcount*census > 0""",
    "attached": """
SELECT l.*, beds FROM coarse_ledger l JOIN beds USING (patient_type, facility_id, date)
UNION ALL SELECT l.*, peak FROM coarse_ledger l LEFT JOIN beds USING (patient_type, facility_id, date)
  JOIN peak USING (patient_type, facility_id) WHERE beds IS NULL""",
    "overflowed": """
SELECT * FROM attached UNION ALL SELECT date, 0, patient_type, 0,0,0,0,0, 99999999
FROM (SELECT DISTINCT date FROM attached) CROSS JOIN (SELECT DISTINCT patient_type FROM attached)""",
    "floored": """
SELECT o.* REPLACE (CASE WHEN o.facility_id<>0 THEN greatest(beds, census+rmax) ELSE beds END AS beds)
FROM overflowed o JOIN (SELECT facility_id, patient_type, CAST(SUM(releases) AS BIGINT) AS rmax FROM overflowed GROUP BY ALL)
  USING (facility_id, patient_type)""",
}

TYPES = ("CANCER_CLINICAL", "CANCER_SURGERY", "OTHER_CLINICAL", "OTHER_SURGERY")
MEASURES = ("admits", "discharges", "net", "census", "releases", "beds")


def _wide(name: str, source: str) -> None:
    cells = ",".join(
        (
            f"COALESCE(last_value(t{i}.{m} IGNORE NULLS) OVER (PARTITION BY k.facility_id ORDER BY k.date),0)"
            if m in ("census", "beds")
            else f"COALESCE(t{i}.{m},0)"
        )
        + f" AS {m}_{t}"
        for m in MEASURES
        for i, t in enumerate(TYPES)
    )
    joins = " ".join(
        f"LEFT JOIN (SELECT * FROM {source} WHERE patient_type='{t}') t{i} ON t{i}.date=k.date AND t{i}.facility_id=k.facility_id"
        for i, t in enumerate(TYPES)
    )
    CTES[name] = f"SELECT k.date, k.facility_id, {cells} FROM (SELECT DISTINCT date, facility_id FROM {source}) k {joins}"
    CTES[f"{name}_dyn"] = f"""
SELECT *, beds_OTHER_CLINICAL-census_OTHER_CLINICAL AS free_other_CLINICAL,
  beds_OTHER_SURGERY-census_OTHER_SURGERY AS free_other_SURGERY,
  CASE WHEN beds_OTHER_CLINICAL<census_OTHER_CLINICAL
    THEN greatest(0, beds_CANCER_CLINICAL+beds_OTHER_CLINICAL-census_OTHER_CLINICAL) ELSE beds_CANCER_CLINICAL END AS dynamic_beds_CLINICAL,
  CASE WHEN beds_OTHER_SURGERY<census_OTHER_SURGERY
    THEN greatest(0, beds_CANCER_SURGERY+beds_OTHER_SURGERY-census_OTHER_SURGERY) ELSE beds_CANCER_SURGERY END AS dynamic_beds_SURGERY
FROM {name}"""
    CTES[f"{name}_long"] = " UNION ALL ".join(
        f"SELECT date, facility_id, 'CANCER_{p}' AS patient_type, CAST(dynamic_beds_{p} AS BIGINT) AS beds, "
        f"CAST(releases_CANCER_{p} AS BIGINT) AS releases, CAST(census_CANCER_{p} AS BIGINT) AS census FROM {name}_dyn"
        for p in ("CLINICAL", "SURGERY")
    )


_wide("wide", "floored")
_wide("rough", "overflowed")


def _balance(source: str) -> str:
    return f"""
SELECT l.*, CAST(COALESCE(i.census,0)-SUM(l.releases) OVER (PARTITION BY l.facility_id, l.patient_type ORDER BY l.date) AS BIGINT) AS remaining
FROM {source} l LEFT JOIN (SELECT facility_id, patient_type, census FROM {source} WHERE date=(SELECT MIN(date) FROM {source})) i
  ON i.facility_id=l.facility_id AND i.patient_type=l.patient_type"""


CTES |= {
    "balance": _balance("wide_long"),
    "long": """
SELECT date, facility_id, patient_type, greatest(beds, remaining) AS beds, releases, census, remaining<0 AS over_released
FROM balance WHERE greatest(beds, remaining) > 0""",
    "initial": """
SELECT patient_type, facility_id, census FROM long WHERE date=(SELECT MIN(date) FROM long) AND census > 0""",
    "releases": "SELECT patient_type, facility_id, date, releases FROM long WHERE releases > 0",
    "loose": "SELECT * FROM rough_long",
    "loose_initial": """
SELECT patient_type, facility_id, census FROM loose WHERE date=(SELECT MIN(date) FROM loose) AND census > 0""",
    "loose_releases": """
SELECT patient_type, facility_id, CAST(SUM(releases) AS BIGINT) AS released FROM loose WHERE releases > 0 GROUP BY ALL""",
    "loose_balance": _balance("loose"),
    "mdemand": f"SELECT * FROM demand WHERE date < {E}",
    "shut_days": """
SELECT *, SUM(shut) OVER (PARTITION BY patient_type, facility_id ORDER BY date) AS upto FROM (
  SELECT k.patient_type, k.facility_id, d.date, CASE WHEN least(COALESCE(beds,0),
    floor(COALESCE(hours,0)/CASE k.patient_type WHEN 'CANCER_CLINICAL' THEN 1 ELSE 2 END)) > 0 THEN 0 ELSE 1 END AS shut
  FROM (SELECT DISTINCT patient_type, facility_id FROM beds WHERE patient_type LIKE 'CANCER%') k CROSS JOIN model_days d
  LEFT JOIN beds b ON b.patient_type=k.patient_type AND b.facility_id=k.facility_id AND b.date=d.date
  LEFT JOIN hours h ON h.facility_id=k.facility_id AND h.date=d.date)""",
    "open_stays": f"""
SELECT s.patient_type, s.facility_id, s.date, true AS is_open FROM shut_days s JOIN los USING (patient_type)
JOIN shut_days e ON e.patient_type=s.patient_type AND e.facility_id=s.facility_id
  AND e.date=least(s.date+CAST(los AS INT), {E})-1
WHERE e.upto-s.upto+s.shut=0""",
    "od": """
SELECT * FROM od_all WHERE area_id IN (SELECT area_id FROM mdemand)""",
    "units": """
SELECT k.area_id, k.date, facility_id, km, COALESCE(exposure,0) AS exposure
FROM (SELECT DISTINCT area_id, date FROM mdemand) k JOIN od USING (area_id) LEFT JOIN exposure USING (date, facility_id)""",
    "bounds": f"""
SELECT SUM(qty*d0) AS best_distance, SUM(qty*d1) AS worst_distance, SUM(qty*e0)*CAST(0.52 AS DOUBLE) AS best_infection,
  SUM(qty*e1)*CAST(0.52 AS DOUBLE) AS worst_infection, SUM(qty*rd0) AS best_distance_real, SUM(qty*rd1) AS worst_distance_real,
  SUM(qty*re0)*CAST(0.52 AS DOUBLE) AS best_infection_real, SUM(qty*re1)*CAST(0.52 AS DOUBLE) AS worst_infection_real
FROM (SELECT * FROM mdemand WHERE date <= {FIRST_LAST}) JOIN (
  SELECT area_id, date, MIN(km) AS d0, MAX(km) AS d1, MIN(exposure) AS e0, MAX(exposure) AS e1,
    MIN(km) FILTER (facility_id<>0) AS rd0, MAX(km) FILTER (facility_id<>0) AS rd1,
    MIN(exposure) FILTER (facility_id<>0) AS re0, MAX(exposure) FILTER (facility_id<>0) AS re1
  FROM units GROUP BY ALL) USING (area_id, date)""",
}
_costs("", "0.1")

CTES |= {
    "hist": f"""
SELECT patient_type, facility_id, admit_date AS date, COUNT(episode_id) AS qty FROM cls
WHERE patient_type LIKE 'CANCER%' AND admit_date < {S} GROUP BY ALL""",
    "day_hours": f"SELECT facility_id, date, hours FROM hours WHERE date < {E}",
    "load_grid": """
SELECT * FROM (SELECT DISTINCT patient_type FROM long) CROSS JOIN (
  SELECT facility_id FROM long UNION SELECT facility_id FROM initial) CROSS JOIN model_days""",
    "loads": """
SELECT g.patient_type, g.facility_id, g.date, beds AS old,
  COALESCE(i.census,0) - COALESCE(h.qty,0) - COALESCE(r.releases,0) AS load
FROM load_grid g LEFT JOIN (SELECT patient_type, facility_id, date, beds FROM long) USING (patient_type, facility_id, date)
LEFT JOIN initial i USING (patient_type, facility_id) LEFT JOIN los USING (patient_type)
LEFT JOIN hist h ON h.patient_type=g.patient_type AND h.facility_id=g.facility_id AND h.date=g.date-CAST(los AS INT)
LEFT JOIN releases r ON r.patient_type=g.patient_type AND r.facility_id=g.facility_id AND r.date=g.date""",
    "hour_loads": """
SELECT facility_id, date, MAX(load*CASE patient_type WHEN 'CANCER_CLINICAL' THEN 1 ELSE 2 END) AS need FROM loads GROUP BY ALL""",
    "seen_demand": f"""
SELECT patient_type, area_id, admit_date AS date, COUNT(episode_id) AS qty FROM cls
WHERE admit_date >= {S} AND admit_date < {E} AND patient_type LIKE 'CANCER%' GROUP BY ALL""",
    "off_demand": """
SELECT 'demand' AS rule, weight, patient_type, area_id AS place, date, CAST(SUM(n) AS BIGINT) AS amount FROM (
  SELECT weight, patient_type, area_id, date, qty AS n FROM plan
  UNION ALL SELECT weight, patient_type, area_id, date, -qty FROM seen_demand CROSS JOIN weights) GROUP BY ALL HAVING SUM(n)<>0""",
    "over_beds": """
SELECT 'beds' AS rule, weight, patient_type, facility_id AS place, date, c.census-COALESCE(beds,0) AS amount
FROM census c LEFT JOIN long l USING (patient_type, facility_id, date) WHERE c.census > COALESCE(beds,0) AND facility_id<>0""",
    "patient_hours": """
SELECT weight, patient_type, facility_id, date, c.census*CASE patient_type WHEN 'CANCER_CLINICAL' THEN 1 ELSE 2 END AS load FROM census c
WHERE facility_id<>0""",
    "edges": """
SELECT admit_date AS date, area_id AS source, facility_area_id AS target, patient_type, CAST(admit_date AS TIMESTAMP) AS ts,
  CAST(trunc(CASE WHEN raw_km=0 THEN 1.0 ELSE raw_km END) AS BIGINT) AS km, COUNT(episode_id) AS weight
FROM cls JOIN hav USING (area_id, facility_area_id)
WHERE CAST(area_id AS VARCHAR) LIKE '11%' AND area_id NOT IN (113,117) GROUP BY ALL""",
    "segs": """
SELECT date, segment, MIN(date) OVER (PARTITION BY segment) AS first
FROM (SELECT date, CAST(ntile(7) OVER (ORDER BY date)-1 AS INT) AS segment FROM model_days)""",
    "seg_initial": """
SELECT weight, 0 AS segment, patient_type, facility_id, census FROM initial CROSS JOIN weights
UNION ALL SELECT weight, segment, patient_type, facility_id, c.census FROM census c
  JOIN (SELECT DISTINCT segment, first FROM segs WHERE segment > 0) s ON c.date=s.first-1 WHERE c.census > 0""",
    "seg_left": """
SELECT weight, patient_type, facility_id, s.date, SUM(qty) AS qty FROM plan p JOIN los USING (patient_type)
JOIN segs s ON s.date=p.date+CAST(los AS INT) WHERE p.date < s.first GROUP BY ALL""",
    "seg_beds": f"""
SELECT weight, patient_type, facility_id, date, CAST(greatest(COALESCE(MAX(old),0), SUM(load)) AS BIGINT) AS beds FROM (
  SELECT weight, patient_type, facility_id, date, 0 AS load, beds AS old FROM long CROSS JOIN weights
  UNION ALL SELECT weight, patient_type, facility_id, s.date, census, NULL FROM seg_initial JOIN segs s USING (segment)
  UNION ALL SELECT weight, patient_type, facility_id, date, -qty, NULL FROM seg_left
  UNION ALL SELECT weight, patient_type, facility_id, date, -releases, NULL FROM releases CROSS JOIN weights WHERE date < {E})
GROUP BY ALL HAVING MAX(old) IS NOT NULL OR SUM(load) > 0""",
    "cell_values": """
SELECT g.weight, s.segment, g.patient_type, g.facility_id, g.date, COALESCE(y.census,0) AS y, COALESCE(f.census,0) AS covid,
  COALESCE(h.hours,0) AS staff_hours, COALESCE(exposure,0) AS exposure, COALESCE(l.beds,0) AS beds, COALESCE(i.census,0) AS initial,
  COALESCE(r.releases,0) AS releases, -COALESCE(los,0) AS neg_los, COALESCE(o.census,0) AS other, COALESCE(b.census,0) AS cancer
FROM (SELECT * FROM weights CROSS JOIN (SELECT DISTINCT patient_type FROM mdemand)
  CROSS JOIN (SELECT facility_id FROM episodes UNION SELECT 0) CROSS JOIN model_days) g
JOIN segs s USING (date)
LEFT JOIN census y USING (weight, patient_type, facility_id, date)
LEFT JOIN infected f USING (facility_id, date) LEFT JOIN hours h USING (facility_id, date)
LEFT JOIN exposure USING (facility_id, date) LEFT JOIN seg_beds l USING (weight, patient_type, facility_id, date)
LEFT JOIN seg_initial i ON i.weight=g.weight AND i.segment=s.segment AND i.patient_type=g.patient_type AND i.facility_id=g.facility_id
LEFT JOIN releases r USING (patient_type, facility_id, date) LEFT JOIN los USING (patient_type)
LEFT JOIN other o USING (facility_id, date)
LEFT JOIN (SELECT weight, facility_id, date, CAST(SUM(c.census) AS BIGINT) AS census FROM census c GROUP BY ALL) b USING (weight, facility_id, date)""",
    "detail": """
SELECT g.weight AS w_distance, round(1-g.weight,4) AS w_infection, g.segment, g.patient_type AS p, a.area_id AS a, g.facility_id AS h,
  g.date AS t, COALESCE(x.qty,0) AS x, y, covid, staff_hours, round(COALESCE(km,0)*COALESCE(x.qty,0),4) AS distance_cost,
  round(exposure*COALESCE(x.qty,0)*CAST(0.52 AS DOUBLE),4) AS infection_cost, beds, COALESCE(d.qty,0) AS demand, y AS patients, initial,
  releases, neg_los, other, cancer
FROM cell_values g CROSS JOIN (SELECT DISTINCT area_id FROM mdemand) a
LEFT JOIN plan x ON x.weight=g.weight AND x.patient_type=g.patient_type AND x.area_id=a.area_id AND x.facility_id=g.facility_id AND x.date=g.date
LEFT JOIN od ON od.area_id=a.area_id AND od.facility_id=g.facility_id
LEFT JOIN mdemand d ON d.patient_type=g.patient_type AND d.area_id=a.area_id AND d.date=g.date
WHERE COALESCE(x.qty,0) > 0 OR covid > 0 OR beds > 0""",
    "typed": """
SELECT patient_type, CAST(row_number() OVER (ORDER BY patient_type)-1 AS INT) AS type_id FROM (SELECT DISTINCT patient_type FROM cls)""",
}


def _key(d: str) -> str:
    return f"CAST(year({d})*10000+month({d})*100+day({d}) AS INT)"


def _segment(d: str) -> str:
    return f"(SELECT date, CAST(ntile(7) OVER (ORDER BY date)-1 AS INT) AS segment FROM model_days) s ON s.date={d}"


#: Greedy assignment; one step is one round, and the steps end when nothing is open.
CAPACITY = """step AS (
SELECT 0 AS round, 'room' AS kind, weight, b.patient_type, CAST(NULL AS BIGINT) AS area_id, b.facility_id, b.date,
  least(beds, CAST(floor(COALESCE(hours,0)/CASE b.patient_type WHEN 'CANCER_CLINICAL' THEN 1 ELSE 2 END) AS BIGINT)) AS n
FROM beds b LEFT JOIN hours USING (facility_id, date) CROSS JOIN weights WHERE b.patient_type LIKE 'CANCER%'
UNION ALL SELECT 0, 'open', weight, patient_type, area_id, NULL, date, qty FROM mdemand CROSS JOIN weights
UNION ALL
SELECT * FROM (
  WITH open AS (SELECT * FROM step WHERE kind='open'), room AS (SELECT * FROM step WHERE kind='room'),
  best AS (
    SELECT o.round, o.weight, o.patient_type, o.area_id, o.date, any_value(o.n) AS qty,
      arg_min(r.facility_id, (c.cost, r.facility_id)) AS facility_id, MIN(c.cost) AS cost, arg_min(r.n, (c.cost, r.facility_id)) AS room
    FROM open o LEFT JOIN (costs c JOIN room r ON r.n > 0 AND r.weight=c.weight AND r.facility_id=c.facility_id AND r.date=c.date)
      ON c.facility_id<>0 AND o.weight=c.weight AND o.area_id=c.area_id AND o.date=c.date AND o.patient_type=r.patient_type
    GROUP BY ALL),
  got AS (
    SELECT *, CASE WHEN facility_id IS NULL THEN qty ELSE greatest(0, least(qty, room -
      (SUM(qty) OVER (PARTITION BY weight, patient_type, facility_id, date ORDER BY cost, area_id) - qty))) END AS n
    FROM best)
  SELECT round+1, 'got', weight, patient_type, area_id, COALESCE(facility_id,0), date, CAST(n AS BIGINT) FROM got WHERE n > 0
  UNION ALL SELECT round+1, 'open', weight, patient_type, area_id, NULL, date, CAST(qty-n AS BIGINT) FROM got WHERE n < qty
  UNION ALL SELECT r.round+1, 'room', r.weight, r.patient_type, NULL, r.facility_id, r.date, CAST(r.n-COALESCE(g.n,0) AS BIGINT)
    FROM room r LEFT JOIN (SELECT weight, patient_type, facility_id, date, SUM(n) AS n FROM got GROUP BY ALL) g
      USING (weight, patient_type, facility_id, date)
    WHERE EXISTS (SELECT 1 FROM got WHERE n < qty)))
SELECT weight, patient_type, area_id, facility_id, date, CAST(SUM(n) AS BIGINT) AS qty FROM step WHERE kind='got' GROUP BY ALL"""


def _table(name: str, source: str, value: str, *keys: str) -> str:
    """Rows, sum of the values and number of different keys of a parameter table."""
    distinct = "+".join(f"COUNT(DISTINCT {k})" for k in keys)
    total = "round(COALESCE(SUM(round(km,6)),0),3)" if value == "km" else f"CAST(COALESCE(SUM({value}),0) AS DOUBLE)"
    return f"SELECT '{name}' AS table_name, COUNT(*) AS n_rows, {total} AS total, {distinct} AS n_keys FROM {source}"


FINAL: dict[str, str] = {
    "read_table": f"SELECT o_custkey, {_key('o_orderdate')} AS o_orderdate FROM orders",
    "read_lookups": """SELECT 'diagnoses' AS lookup, 'P'||p_partkey AS code, CASE WHEN p_type='PROMO' THEN 'CANCER' ELSE 'OTHER' END AS value FROM part
UNION ALL SELECT 'procedures', CAST(p_partkey AS VARCHAR), CASE WHEN p_size > 25 THEN 'SURGERY' ELSE 'CLINICAL' END FROM part
UNION ALL SELECT 'beds', CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey=12 THEN 'CANCER_SURGERY' WHEN s_suppkey=44 THEN 'CANCER_CLINICAL'
  WHEN s_suppkey % 3=1 THEN 'OTHER_SURGERY' ELSE 'OTHER_CLINICAL' END FROM supplier
UNION ALL SELECT 'occupations', CAST(s_suppkey AS VARCHAR), s_name FROM supplier""",
    "write_table": "SELECT patient_type, area_id, date, qty FROM flows",
    "save_params": """SELECT facility_id, patient_type, date, beds AS amount FROM beds
UNION ALL SELECT facility_id, NULL, date, h.hours FROM hours h""",
    "param_table": f"SELECT type_id AS p, area_id AS a, {_key('date')} AS t, qty AS value FROM demand JOIN typed USING (patient_type)",
    "disease_group": "SELECT code, disease FROM diagnoses",
    "disease_group_coarse": "SELECT code, disease_coarse FROM diagnoses",
    "procedure_group": """SELECT episode_id, diagnosis_code, CASE WHEN procedure_code='R' THEN 'SURGERY' ELSE 'CLINICAL' END AS treatment FROM episodes""",
    "bed_group": """SELECT facility_id, bed_code, month_key, CASE WHEN bed_code=12 THEN 'CANCER_SURGERY' WHEN bed_code=44 THEN 'CANCER_CLINICAL'
 WHEN bed_kind=1 THEN 'OTHER_SURGERY' ELSE 'OTHER_CLINICAL' END AS bed_group FROM bed_rows""",
    "classify_episodes": "SELECT episode_id, diagnosis_code, facility_id, admit_date, patient_type, patient_type_coarse FROM cls",
    "classify_beds": "SELECT facility_id, bed_code, month_key, qty, bed_group FROM beds_cls",
    "classify_staff": "SELECT * FROM staff_cls",
    "encode_types": f"""SELECT f.*, type_id FROM flows f JOIN (
 SELECT patient_type, CAST(row_number() OVER (ORDER BY patient_type)-1 AS INT) AS type_id FROM (
  SELECT DISTINCT patient_type FROM cls WHERE admit_date >= {S} AND admit_date < {E})) USING (patient_type)""",
    "shift_date_key": f"""SELECT episode_id, diagnosis_code, {_key('admit_date')} AS admit_key,
 {_key('(admit_date+stay_days)')} AS later_key, {_key('(admit_date-stay_days)')} AS earlier_key FROM episodes""",
    "date_key": f"""SELECT o_orderkey, {_key('o_orderdate')} AS order_key, CAST(o_orderdate AS DATE) AS order_date,
 CAST(isodow(o_orderdate)-1 AS INT) AS weekday FROM orders""",
    "date_spine": """SELECT CAST(d AS DATE) AS date, COALESCE(n,0) AS admits FROM (
 SELECT unnest(generate_series(MIN(least(admit_date,discharge_date)), MAX(greatest(admit_date,discharge_date)), INTERVAL 1 DAY)) AS d FROM episodes)
 LEFT JOIN (SELECT admit_date, COUNT(episode_id) AS n FROM episodes GROUP BY ALL) ON admit_date=CAST(d AS DATE)""",
    "monthly_to_daily": "SELECT facility_id, bed_code, qty, date FROM bed_rows JOIN plan_days ON year(date)*100+month(date)=month_key",
    "split_horizon": f"""SELECT s.date, n AS admits, segment FROM (SELECT admit_date AS d, COUNT(episode_id) AS n FROM episodes GROUP BY ALL)
 JOIN {_segment('d')}""",
    "slice_by_segment": f"SELECT f.*, segment FROM flows f JOIN {_segment('f.date')}",
    "haversine": """SELECT episode_id, diagnosis_code, facility_id, round(CASE WHEN raw_km=0 THEN 1.0 ELSE raw_km END,6) AS km
 FROM episodes JOIN hav USING (area_id, facility_area_id)""",
    "area_distances": "SELECT area_id, facility_area_id, round(km,6) AS km FROM area_km",
    "facility_distances": "SELECT area_id, facility_id, round(km,6) AS km FROM facility_km",
    "overflow_distance": "SELECT area_id, facility_id, round(km,6) AS km FROM od_all",
    "restrict_od": """SELECT area_id, facility_id, round(km,6) AS km FROM od_all WHERE area_id IN (SELECT area_id FROM demand)
 AND (facility_id=0 OR facility_id IN (SELECT facility_id FROM episodes))""",
    "daily_demand": "SELECT * FROM daily_cancer",
    "weekday_profile": "SELECT area_id, patient_type, CAST(weekday AS INT) AS weekday, round(qty,6) AS qty FROM profile_region",
    "project_demand": "SELECT date, area_id, patient_type, round(qty,6) AS qty FROM projected_region",
    "integerize_demand": "SELECT * FROM whole_region",
    "integerize_demand_prefix": "SELECT * FROM demand_of_11",
    "flow_counts": "SELECT * FROM flows",
    "length_of_stay": "SELECT * FROM los_all",
    "movements": "SELECT * FROM fine_mov",
    "running_census": "SELECT * FROM fine_sparse",
    "scheduled_releases": "SELECT * FROM fine_rel",
    "densify": """SELECT date, patient_type, facility_id, admits, discharges, census FROM proc_grid
 LEFT JOIN proc_sparse USING (patient_type, facility_id, date)""",
    "forward_fill": "SELECT date, patient_type, facility_id, census FROM proc_dense",
    "census_ledger": "SELECT * FROM fine_ledger",
    "census_ledger_coarse": "SELECT * FROM coarse_ledger",
    "census_ledger_history": "SELECT * FROM proc_dense",
    "census_ledger_batches": "SELECT * FROM proc_dense",
    "peak_census": "SELECT * FROM peak",
    "census_by_group": "SELECT * FROM other",
    "occupancy_report": """SELECT facility_id, date, CAST(SUM(census) FILTER (patient_type LIKE 'CANCER%') AS BIGINT) AS cancer,
 CAST(SUM(census) FILTER (patient_type LIKE 'COVID%') AS BIGINT) AS covid,
 CAST(SUM(census) FILTER (patient_type LIKE 'OTHER%') AS BIGINT) AS other, CAST(SUM(census) AS BIGINT) AS total FROM fine_ledger GROUP BY ALL""",
    "daily_beds": "SELECT * FROM beds",
    "daily_staff": "SELECT * FROM staff_days",
    "staff_headcount": "SELECT * FROM headcount",
    "staff_hours": "SELECT * FROM hours",
    "overflow_census": "SELECT * FROM covid_over",
    "infection_exposure": "SELECT * FROM exposure",
    "infected_census": "SELECT * FROM infected",
    "attach_beds": "SELECT * FROM attached",
    "overflow_beds": "SELECT * FROM overflowed",
    "floor_beds": "SELECT * FROM floored",
    "pivot_types": "SELECT * FROM wide",
    "borrow_beds": """SELECT date, facility_id, free_other_CLINICAL, free_other_SURGERY, dynamic_beds_CLINICAL, dynamic_beds_SURGERY FROM rough_dyn""",
    "unpivot_types": "SELECT * FROM rough_long",
    "floor_beds_initial": "SELECT * FROM long",
    "bed_adjust_audit": """SELECT date, facility_id, census_CANCER_SURGERY+census_CANCER_CLINICAL AS cancer_census,
 census_OTHER_SURGERY+census_OTHER_CLINICAL AS other_census, dynamic_beds_CLINICAL AS dynamic_beds_clinical,
 dynamic_beds_SURGERY AS dynamic_beds_surgery FROM wide_dyn""",
    "raise_capacity": """SELECT 'beds' AS kind, patient_type, facility_id, date, COALESCE(old,0) AS before,
 greatest(COALESCE(old,0), load) AS after, greatest(COALESCE(old,0), load)-COALESCE(old,0) AS raised FROM loads WHERE old IS NOT NULL OR load > 0
UNION ALL SELECT 'hours', NULL, facility_id, date, COALESCE(hours,0), greatest(COALESCE(hours,0), COALESCE(need,0)),
 greatest(COALESCE(hours,0), COALESCE(need,0))-COALESCE(hours,0) FROM day_hours FULL JOIN hour_loads USING (facility_id, date)
 WHERE hours IS NOT NULL OR need > 0""",
    "initial_census": "SELECT * FROM initial",
    "release_table": "SELECT * FROM releases",
    "capacity_table": "SELECT patient_type, facility_id, date, beds FROM long",
    "index_sets": f"""SELECT DISTINCT 'types' AS set_name, patient_type AS member FROM demand
UNION ALL SELECT DISTINCT 'areas', CAST(area_id AS VARCHAR) FROM demand
UNION ALL SELECT 'facilities', CAST(f AS VARCHAR) FROM (SELECT facility_id AS f FROM episodes UNION SELECT 0)
UNION ALL SELECT 'days', CAST({_key('date')} AS VARCHAR) FROM model_days""",
    "scenario_zero": "SELECT facility_id, patient_type, date, CAST(0 AS BIGINT) AS beds FROM beds",
    "scenario_relax": "SELECT facility_id, patient_type, date, CAST(9999999 AS BIGINT) AS beds FROM beds",
    "scenario_total": "SELECT CAST(SUM(beds) AS BIGINT) AS total FROM beds",
    "weight_grid": """SELECT d.*, CAST(weight AS DOUBLE) AS weight, CAST(round(1-weight,1) AS DOUBLE) AS weight_infection FROM demand d CROSS JOIN weights""",
    "pair_costs": "SELECT weight, area_id, facility_id, date, round(cost,9) AS cost FROM costs",
    "assign_lowest_cost": "SELECT * FROM plan",
    "assign_cheapest": "SELECT * FROM plan",
    "objective_bounds": "SELECT round(COLUMNS(*),3) FROM bounds",
    "score_plan": """SELECT weight, round(dc,3) AS distance_cost, round(ic,3) AS infection_cost,
 round((dc-best_distance)/(worst_distance-best_distance),9) AS distance_norm,
 round((ic-best_infection)/(worst_infection-best_infection),9) AS infection_norm,
 round(weight*(dc-best_distance)/(worst_distance-best_distance)+round(1-weight,1)*(ic-best_infection)/(worst_infection-best_infection),9) AS total
FROM (SELECT weight, SUM(qty*km) AS dc, SUM(qty*COALESCE(exposure,0))*CAST(0.52 AS DOUBLE) AS ic FROM plan JOIN od USING (area_id, facility_id)
 LEFT JOIN exposure USING (date, facility_id) GROUP BY ALL) CROSS JOIN bounds""",
    "plan_census": "SELECT * FROM census",
    "carry_over": f"SELECT weight, patient_type, facility_id, census FROM census c WHERE date={FIRST_LAST} AND c.census > 0",
    "plan_history": """SELECT weight, segment, patient_type, area_id, facility_id, date, qty FROM plan JOIN segs USING (date)
 WHERE qty > 0 AND segment < 2""",
    "plan_horizon_demand": "SELECT weight, patient_type, area_id, date, qty FROM mdemand CROSS JOIN weights",
    "plan_horizon_violations": """SELECT 'demand' AS rule, weight, patient_type, area_id AS place, date, qty AS amount FROM plan WHERE false""",
    "plan_horizon_slack": "SELECT * FROM plan",
    "exchanged_violations": """SELECT 'demand' AS rule, weight, patient_type, area_id AS place, date, qty AS amount FROM plan WHERE false""",
    "capacity_bounds_outside": "SELECT '' AS name, best_distance AS inner, best_distance AS outer FROM bounds WHERE false",
    "cheapest_open_ways": """SELECT weight, patient_type, area_id, date, any_value(qty) AS qty,
 arg_min(facility_id, (cost, facility_id)) AS facility_id, round(MIN(cost),9) AS cost
FROM mdemand JOIN costs USING (area_id, date) LEFT JOIN open_stays USING (patient_type, facility_id, date)
WHERE facility_id=0 OR is_open GROUP BY ALL""",
    "check_initial_beds": f"""SELECT patient_type, facility_id, beds, COALESCE(i.census,0) AS initial, COALESCE(released,0) AS released
 FROM loose l LEFT JOIN loose_initial i USING (patient_type, facility_id) LEFT JOIN loose_releases USING (patient_type, facility_id)
 WHERE date={S} AND beds > 0 AND COALESCE(i.census,0)+COALESCE(released,0) > beds""",
    "check_releases": """SELECT patient_type, facility_id, census AS initial, released FROM loose_initial JOIN loose_releases USING (patient_type, facility_id)
 WHERE released > census""",
    "check_running_releases": "SELECT patient_type, facility_id, date, remaining FROM loose_balance WHERE remaining < 0",
    "check_plan": """SELECT * FROM off_demand UNION ALL SELECT * FROM over_beds
UNION ALL SELECT 'staff', weight, patient_type, facility_id, date, load-COALESCE(hours,0) FROM patient_hours LEFT JOIN hours USING (facility_id, date)
 WHERE load > COALESCE(hours,0)""",
    "check_plan_pooled": """SELECT * FROM off_demand UNION ALL SELECT * FROM over_beds
UNION ALL SELECT 'staff', weight, NULL, facility_id, date, load-COALESCE(hours,0) FROM (
 SELECT weight, facility_id, date, CAST(SUM(load) AS BIGINT) AS load FROM patient_hours GROUP BY ALL) LEFT JOIN hours USING (facility_id, date)
 WHERE load > COALESCE(hours,0)""",
    "flow_edges": "SELECT * FROM edges",
    "flow_nodes": "SELECT area_id AS id, lat, lon FROM coords WHERE area_id IN (SELECT source FROM edges UNION SELECT target FROM edges)",
    "plan_detail": "SELECT * FROM detail",
    "plan_edges": "SELECT w_distance, segment, t AS ts, a AS source, h AS target, x AS weight FROM detail",
}

FINAL["assign_with_capacity"] = CAPACITY
FINAL["build_params"] = "\nUNION ALL ".join(
    [
        _table("demand", "demand", "qty", "patient_type", "area_id", "date"),
        _table("capacity", "long", "beds", "patient_type", "facility_id", "date"),
        _table("releases", "releases", "releases", "patient_type", "facility_id", "date"),
        _table("initial", "initial i", "i.census", "patient_type", "facility_id"),
        _table("los", "los", "los", "patient_type"),
        _table("distance", "(SELECT * FROM od_all WHERE area_id IN (SELECT area_id FROM demand))", "km", "area_id", "facility_id"),
        _table("exposure", "exposure e", "e.exposure", "date", "facility_id"),
        _table("infected", "infected i", "i.census", "date", "facility_id"),
        _table("other", "other o", "o.census", "date", "facility_id"),
        _table("staff_hours", "hours h", "h.hours", "facility_id", "date"),
        _table("types", "(SELECT patient_type, row_number() OVER (ORDER BY patient_type)-1 AS type_id FROM los_all)", "type_id", "patient_type"),
        f"""SELECT 'sets', COUNT(*), CAST(COUNT(DISTINCT member) AS DOUBLE), COUNT(DISTINCT set_name)+COUNT(DISTINCT member)
FROM ({FINAL["index_sets"]})""",
    ]
)


def _needed(text: str) -> list[str]:
    """CTEs that a statement uses, directly or not, in definition order."""
    found: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"\b(\w+)\b", todo.pop()))
        for name in words & CTES.keys() - found:
            found.add(name)
            todo.append(CTES[name])
    return [n for n in _order() if n in found]


def _order() -> list[str]:
    """Names sorted so that a CTE follows those it uses."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out:
            return
        for dep in set(re.findall(r"(?:FROM|JOIN)\s+\(*\s*(\w+)\b", CTES[name])) & CTES.keys():
            if dep != name:
                visit(dep)
        out.append(name)

    for name in CTES:
        visit(name)
    return out


def build() -> dict[str, str]:
    out = {}
    for name, final in FINAL.items():
        ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in _needed(final))
        joiner = ",\n" if final is CAPACITY else "\n"
        out[name] = f"WITH RECURSIVE {ctes}{joiner}{final}" if ctes else final
    return out
