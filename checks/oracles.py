"""Independent SQL (DuckDB dialect) for the registered queries, over the same tables."""

from __future__ import annotations

CONTRACTS = r"""
k AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS id_contrato,
    c_name AS nombre_entidad, concat('NIT', o_custkey) AS nit_entidad,
    concat('Prov ', s_nationkey) AS proveedor, concat('DOC', s_nationkey) AS doc_proveedor,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Contratación directa' WHEN '2-HIGH' THEN 'Licitación pública'
      WHEN '3-MEDIUM' THEN 'Contratación Directa (con ofertas)'
      WHEN '4-NOT SPECIFIED' THEN 'Mínima cuantía' ELSE '  ' END AS modalidad,
    p_type AS tipo_contrato, r_name AS departamento, n_name AS ciudad,
    o_orderdate AS fecha_firma, l_shipdate AS fecha_inicio,
    l_shipdate + to_days(CAST(l_quantity AS INT) - 3) AS fecha_fin,
    CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'N/D'
      WHEN l_discount >= 0.10::DOUBLE THEN '0'
      ELSE '$ ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS valor_raw,
    CASE WHEN l_linenumber % 3 = 0 THEN p_name
      ELSE concat_ws(' ', p_name, p_type, p_brand, o_orderpriority) END AS objeto_raw
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
),
m AS (
  SELECT *, replace(replace(replace(trim(valor_raw), '$', ''), ',', ''), ' ', '') AS texto,
    CAST(length(trim(coalesce(objeto_raw, ''))) AS BIGINT) AS longitud_objeto,
    CAST(date_diff('day', fecha_inicio, fecha_fin) AS BIGINT) AS duracion_dias,
    CAST(year(fecha_inicio) AS BIGINT) AS anio
  FROM k
),
v AS (
  SELECT * EXCLUDE (texto),
    CASE WHEN regexp_full_match(texto, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN TRY_CAST(texto AS DOUBLE) END AS valor_num
  FROM m
),
e AS (
  SELECT *,
    CASE WHEN fecha_fin < fecha_inicio THEN 1 ELSE 0 END AS flag_fin_antes_inicio,
    CASE WHEN fecha_firma > fecha_inicio THEN 1 ELSE 0 END AS flag_firma_despues_inicio,
    CASE WHEN valor_num IS NULL OR valor_num <= 0 THEN 1 ELSE 0 END AS flag_valor_invalido,
    CASE WHEN longitud_objeto < 30 THEN 1 ELSE 0 END AS flag_objeto_muy_corto,
    CASE WHEN duracion_dias < 0 THEN 1 ELSE 0 END AS flag_duracion_negativa,
    CASE WHEN lower(coalesce(modalidad, '')) LIKE '%direct%' THEN 1 ELSE 0 END AS es_directa,
    (valor_num IS NULL OR valor_num <= 0 OR fecha_fin < fecha_inicio OR duracion_dias IS NULL OR duracion_dias <= 0) AS descartado,
    (duracion_dias > 0 AND valor_num > 0) AS elegible
  FROM v
)"""

ENRICHED = """id_contrato, nombre_entidad, nit_entidad, proveedor, doc_proveedor, modalidad, tipo_contrato,
 departamento, ciudad, fecha_firma, fecha_inicio, fecha_fin, valor_num, longitud_objeto, duracion_dias,
 flag_fin_antes_inicio, flag_firma_despues_inicio, flag_valor_invalido, flag_objeto_muy_corto, flag_duracion_negativa"""

RAW = """id_contrato, nombre_entidad, nit_entidad, proveedor, doc_proveedor, modalidad, tipo_contrato,
 departamento, ciudad, fecha_firma, fecha_inicio, fecha_fin, valor_raw, objeto_raw"""

FLAG_SUMS = """count(*) AS total, coalesce(sum(flag_fin_antes_inicio), 0)::BIGINT AS n_fin_antes_inicio,
 coalesce(sum(flag_firma_despues_inicio), 0)::BIGINT AS n_firma_despues_inicio,
 coalesce(sum(flag_valor_invalido), 0)::BIGINT AS n_valor_invalido,
 coalesce(sum(flag_objeto_muy_corto), 0)::BIGINT AS n_objeto_muy_corto,
 coalesce(sum(flag_duracion_negativa), 0)::BIGINT AS n_duracion_negativa,
 count(*) FILTER (WHERE flag_fin_antes_inicio + flag_firma_despues_inicio + flag_valor_invalido
   + flag_objeto_muy_corto + flag_duracion_negativa > 0) AS n_con_alguna_alerta"""

POPULATION = """count(*) AS total, count(*) FILTER (WHERE descartado) AS n_discarded,
 count(*) FILTER (WHERE NOT descartado) AS n_analyzed,
 count(*) FILTER (WHERE flag_valor_invalido = 1) AS n_discard_valor,
 count(*) FILTER (WHERE flag_fin_antes_inicio = 1 OR flag_firma_despues_inicio = 1 OR flag_duracion_negativa = 1) AS n_discard_fechas,
 count(*) FILTER (WHERE duracion_dias IS NULL OR duracion_dias <= 0) AS n_discard_duracion,
 count(*) FILTER (WHERE longitud_objeto = 0) AS n_discard_objeto_vacio"""

IN_SCOPE = "departamento = 'ASIA' AND fecha_inicio >= TIMESTAMP '1997-01-01' AND fecha_inicio < TIMESTAMP '1998-01-01'"


def fixed(expr: str, digits: int = 5) -> str:
    scale = f"1e{digits}"
    return f"(floor(({expr}) * {scale} + 0.3::DOUBLE) / {scale})"


def norm(expr: str) -> str:
    return rf"upper(trim(regexp_replace(strip_accents({expr}), '\s+', ' ', 'g')))"


def quantile(source: str, value: str, p: float, name: str, by: str = "") -> str:
    """CTE ``name``: linearly interpolated quantile as column q, per ``by`` if given."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
{name}_r AS (SELECT {keys}{value} AS x, row_number() OVER ({part} ORDER BY {value}) - 1 AS i,
  {p}::DOUBLE * (count(*) OVER ({part}) - 1) AS pos FROM {source} WHERE {value} IS NOT NULL),
{name}_e AS (SELECT {keys}max(pos) - floor(max(pos)) AS s, max(x) FILTER (WHERE i = floor(pos)) AS lo,
  max(x) FILTER (WHERE i = ceil(pos)) AS hi FROM {name}_r {group}),
{name} AS (SELECT {keys}CASE WHEN s < 0.5::DOUBLE THEN lo + (hi - lo) * s ELSE hi - (hi - lo) * (1 - s) END AS q FROM {name}_e)"""


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


SPELLED = """
sp AS (
  SELECT fecha_inicio, modalidad,
    CASE modalidad WHEN 'Contratación directa' THEN departamento
      WHEN 'Licitación pública' THEN '  ' || lower(departamento) || ' '
      WHEN 'Contratación Directa (con ofertas)' THEN translate(departamento, 'AEIOU', 'ÁÉÍÓÚ')
      WHEN 'Mínima cuantía' THEN CASE WHEN departamento = 'AMERICA' THEN 'Distrito Capital de Bogotá' ELSE 'Zona ' || departamento END
      ELSE 'No Definido' END AS departamento,
    CASE modalidad WHEN 'Contratación directa' THEN ciudad
      WHEN 'Licitación pública' THEN CASE WHEN ciudad = 'NATION_6' THEN 'Santa Fe de Bogotá' ELSE lower(ciudad) END
      WHEN 'Contratación Directa (con ofertas)' THEN 'Ciudad de ' || ciudad
      WHEN 'Mínima cuantía' THEN ciudad[1:8]
      ELSE ' ' END AS ciudad
  FROM k
),
mapa AS (
  SELECT n_nationkey::BIGINT AS orden, CASE WHEN r_name = 'AMERICA' THEN 'BOGOTÁ, D.C.' ELSE r_name END AS dpto,
    CASE WHEN n_name = 'NATION_6' THEN 'BOGOTÁ, D.C.' ELSE n_name END AS mpio
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
deptos AS (SELECT dpto, min(orden) AS orden FROM mapa GROUP BY 1),
por_depto AS (SELECT trim(departamento) AS departamento, count(*) AS n_contratos FROM sp
  WHERE departamento IS NOT NULL AND trim(departamento) <> '' GROUP BY 1),
por_ciudad AS (SELECT departamento, trim(ciudad) AS ciudad, count(*) AS n_contratos FROM sp
  WHERE ciudad IS NOT NULL AND trim(ciudad) <> '' GROUP BY 1, 2)"""


def matched(source: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT s.*, CASE WHEN {norm('s.departamento')} IN ('DISTRITO CAPITAL DE BOGOTA', 'DISTRITO CAPITAL') THEN 'BOGOTÁ, D.C.'
    ELSE d.dpto END AS dpto
  FROM {source} s LEFT JOIN deptos d ON {norm('s.departamento')} = {norm('d.dpto')}
)"""


def tiers(source: str, name: str) -> str:
    """CTE ``name``: the rows of ``source`` (dpto, ciudad, ...) with mpio and nivel."""
    c, m = norm("s.ciudad"), norm("t.mpio")
    return f"""
{name}_c AS (
  SELECT s.*, t.mpio, t.orden AS orden_mpio,
    CASE WHEN {c} IN ('BOGOTA', 'SANTA FE DE BOGOTA') AND {m} = 'BOGOTA, D.C.' THEN 1
      WHEN {m} = {c} THEN 2
      WHEN (contains({m}, {c}) OR contains({c}, {m})) AND abs(length({m}) - length({c})) <= 22 THEN 3 END AS nivel
  FROM {source} s JOIN mapa t ON s.dpto = t.dpto WHERE {c} NOT IN ('', 'NO DEFINIDO')
),
{name} AS (
  SELECT * EXCLUDE (orden_mpio) FROM {name}_c WHERE nivel IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dpto, ciudad ORDER BY nivel, orden_mpio) = 1
)"""


CITIES = """
ciudades AS (SELECT dpto, ciudad, sum(n_contratos)::BIGINT AS n_contratos FROM pc WHERE dpto IS NOT NULL GROUP BY 1, 2)"""

PAIR_KEYS = "nit_entidad, nombre_entidad, doc_proveedor, proveedor"


def pairs(days: int) -> str:
    return f"""
a AS (SELECT *, valor_num / duracion_dias AS costo FROM e WHERE NOT descartado),
ent AS (SELECT nit_entidad, count(*) AS n_entidad_anio FROM a GROUP BY 1),
vent AS (SELECT nit_entidad, doc_proveedor, fecha_inicio, count(*) OVER (PARTITION BY nit_entidad, doc_proveedor
  ORDER BY fecha_inicio RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND CURRENT ROW) AS n FROM a),
pico AS (SELECT nit_entidad, doc_proveedor, max(n) AS max_contratos_ventana FROM vent GROUP BY 1, 2),
par AS (
  SELECT {PAIR_KEYS}, count(*) AS n_contratos, sum(valor_num) AS suma_valor, avg(valor_num) AS promedio_valor,
    avg(costo) AS costo_dia_promedio, avg(duracion_dias) AS duracion_promedio,
    avg(es_directa::DOUBLE) AS ratio_directa,
    avg(CASE WHEN longitud_objeto < 30 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS pct_objeto_corto,
    count(DISTINCT trim(coalesce(objeto_raw, ''))[1:50]) AS diversidad_objetos, min(longitud_objeto) AS min_longitud_objeto
  FROM a GROUP BY ALL
),
pares AS (
  SELECT par.*, coalesce(max_contratos_ventana, n_contratos) AS max_contratos_ventana,
    n_contratos::DOUBLE / n_entidad_anio AS concentracion_entidad, n_entidad_anio
  FROM par JOIN ent USING (nit_entidad) LEFT JOIN pico USING (nit_entidad, doc_proveedor)
)"""


RULES = (
    ("contratacion_directa", 0.15, "Ratio contratación directa ≥ 50 %", "alta contratación directa"),
    ("frecuencia_temporal", 0.25, "≥ 3 contratos en ventana corta", "ráfaga de contratos en ventana corta"),
    ("proveedor_dominante", 0.20, "Concentración del proveedor en la entidad ≥ 25 %", "proveedor dominante en la entidad"),
    ("objeto_generico", 0.10, "≥ 50 % de contratos con objeto muy corto (< 30 car.)", "objetos contractuales genéricos"),
    ("costo_dia_extremo", 0.15, "Costo/día promedio en percentil 90+ del cohorte", "costo/día promedio elevado"),
)
SCORED = (
    "grandes AS (SELECT * FROM pares WHERE n_contratos >= 2)",
    quantile("grandes", "costo_dia_promedio", 0.9, "p90"),
    """reglas AS (SELECT g.*, ratio_directa >= 0.5::DOUBLE AS contratacion_directa, max_contratos_ventana >= 2 AS frecuencia_temporal,
  concentracion_entidad >= 0.25::DOUBLE AS proveedor_dominante, pct_objeto_corto >= 0.5::DOUBLE AS objeto_generico,
  coalesce(costo_dia_promedio, 0) >= q AS costo_dia_extremo FROM grandes g, p90)""",
    "puntos AS (SELECT *, least(1::DOUBLE, greatest(0::DOUBLE, "
    + " + ".join(f"(CASE WHEN {r} THEN {w}::DOUBLE ELSE 0::DOUBLE END)" for r, w, _, _ in RULES)
    + ")) AS score_reglas, concat_ws('; ', "
    + ", ".join(f"CASE WHEN {r} THEN '{t}' END" for r, _, t, _ in RULES)
    + ") AS reglas_disparadas, concat_ws('; ', "
    + ", ".join(f"CASE WHEN {r} THEN '{f}' END" for r, _, _, f in RULES)
    + ") AS frases FROM reglas)",
)

PAIR_OUT = f"""{PAIR_KEYS}, n_contratos, {fixed('suma_valor', 2)} AS suma_valor, {fixed('promedio_valor')} AS promedio_valor,
 {fixed('costo_dia_promedio')} AS costo_dia_promedio, {fixed('duracion_promedio')} AS duracion_promedio,
 {fixed('ratio_directa')} AS ratio_directa, {fixed('pct_objeto_corto')} AS pct_objeto_corto, diversidad_objetos,
 min_longitud_objeto, max_contratos_ventana, {fixed('concentracion_entidad', 8)} AS concentracion_entidad, n_entidad_anio"""


def trailing(source: str, keys: str, stamp: str, days: int, where: str = "true") -> str:
    return f"""SELECT {keys}, {stamp}, count(*) AS n_filas, max(n) AS n_ventana FROM (
  SELECT {keys}, {stamp}, count(*) OVER (PARTITION BY {keys} ORDER BY {stamp}
    RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND CURRENT ROW) AS n FROM {source} WHERE {where}) GROUP BY ALL"""


def label(x: str) -> str:
    def scaled(unit: str, digits: int, suffix: str) -> str:
        return rf"regexp_replace(format('{{:.{digits}f}}', {x} / {unit}), '\.?0+$', '') || ' {suffix}'"

    return f"""CASE WHEN {x} IS NULL THEN '' WHEN {x} >= 1e9 THEN {scaled('1e9', 4, 'MM COP')}
 WHEN {x} >= 1e6 THEN {scaled('1e6', 3, 'M COP')} ELSE format('{{:,.0f}}', {x}) || ' COP' END"""


POINTS = "pt AS (SELECT id_contrato, valor_num, duracion_dias, valor_num / abs(duracion_dias) AS costo FROM e WHERE elegible)"
TRIMMED = (POINTS, quantile("pt", "costo", 0.99, "p99"), "tr AS (SELECT pt.* FROM pt, p99 WHERE costo <= q AND costo > 0)")

CHANGES = """
orden AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders),
base AS (SELECT * FROM orden WHERE o_orderstatus <> 'P'),
cambios AS (SELECT o_orderkey, o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orden WHERE o_orderstatus <> 'F'),
bajas AS (SELECT o_orderkey FROM orden WHERE o_orderstatus = 'F' AND o_totalprice < 100000),
nueva AS (SELECT * FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM cambios) UNION ALL SELECT * FROM cambios)"""

VALOR_TEXT = "tx AS (SELECT id_contrato, replace(valor_raw, '$ ', '') AS valor FROM k)"


def _sql() -> dict[str, str]:
    q: dict[str, str] = {}

    def on(name: str, select: str, *ctes: str) -> None:
        q[name] = with_(CONTRACTS, *ctes, select=select)

    on("quality_summary", f"SELECT departamento, anio, {FLAG_SUMS} FROM e GROUP BY 1, 2")
    on("quality_summary_region_year", f"SELECT {FLAG_SUMS} FROM e WHERE {IN_SCOPE}")
    on("quality_sample", f"SELECT {ENRICHED} FROM e ORDER BY id_contrato LIMIT 500")
    on("enriched_contracts", f"SELECT {ENRICHED} FROM e")
    q["stream_flags"] = q["enriched_contracts"]
    on("alert_distribution", """SELECT departamento, regla, n FROM (UNPIVOT (SELECT departamento,
 n_fin_antes_inicio AS "Fin antes de inicio", n_firma_despues_inicio AS "Firma después de inicio",
 n_valor_invalido AS "Valor inválido", n_objeto_muy_corto AS "Objeto muy corto", n_duracion_negativa AS "Duración negativa" FROM s)
 ON COLUMNS(* EXCLUDE (departamento)) INTO NAME regla VALUE n) WHERE n > 0""",
       f"s AS (SELECT departamento, {FLAG_SUMS} FROM e GROUP BY 1)")
    on("quality_kpis", f"""SELECT departamento, anio, total, n_con_alguna_alerta, n_discarded,
 {fixed('100::DOUBLE * n_con_alguna_alerta / greatest(1, total)')} AS pct_con_alerta,
 {fixed('100::DOUBLE * n_discarded / greatest(1, total)')} AS pct_descartado FROM s""",
       f"""s AS (SELECT departamento, anio, {FLAG_SUMS}, count(*) FILTER (WHERE descartado) AS n_discarded FROM e GROUP BY 1, 2)""")
    on("population_counts", f"SELECT departamento, anio, {POPULATION} FROM e GROUP BY 1, 2")
    on("partitioned_copy", f"SELECT {POPULATION} FROM e WHERE {IN_SCOPE}")
    on("inconsistent_contracts", "SELECT id_contrato, duracion_dias, flag_firma_despues_inicio FROM e WHERE duracion_dias <= 0 OR flag_firma_despues_inicio = 1")

    on("count_filtered", "SELECT departamento, ciudad, anio, count(*) AS n, count(*) FILTER (WHERE elegible) AS n_elegibles FROM e GROUP BY 1, 2, 3")
    on("year_range", "SELECT departamento, ciudad, min(anio) AS anio_min, max(anio) AS anio_max FROM e GROUP BY 1, 2")
    on("page_deep", f"""SELECT * FROM (SELECT {RAW}, row_number() OVER (ORDER BY id_contrato) AS n_fila FROM k)
 WHERE n_fila > (SELECT (count(*) - 1) // 10 * 10 FROM k)""")
    on("page_by_id", f"SELECT {RAW}, row_number() OVER (ORDER BY id_contrato) AS n_fila FROM k ORDER BY id_contrato LIMIT 10 OFFSET 30")
    on("page_keyset", f"SELECT {RAW} FROM k WHERE id_contrato > '2000-' ORDER BY id_contrato LIMIT 10")
    on("page_bounds", """SELECT departamento, anio, n, paginas, least(greatest(40, 1), paginas) AS pagina FROM (
 SELECT departamento, anio, count(*) AS n, greatest(1, ceil(count(*) / 10::DOUBLE))::BIGINT AS paginas FROM e GROUP BY 1, 2)""")
    buckets = """count(*) FILTER (WHERE fecha_inicio >= TIMESTAMP '1996-01-01' AND fecha_inicio < TIMESTAMP '1999-01-01') AS desde_1996_hasta_1998,
 count(*) FILTER (WHERE fecha_inicio >= TIMESTAMP '1999-01-01' AND fecha_inicio < TIMESTAMP '2000-01-01') AS solo_1999,
 count(*) FILTER (WHERE fecha_inicio < TIMESTAMP '1996-01-01') AS antes_1996"""
    on("date_buckets", f"""SELECT 'region' AS alcance, {buckets} FROM k WHERE departamento = 'AMERICA'
 UNION ALL SELECT 'ciudad', {buckets} FROM k WHERE departamento = 'AMERICA' AND ciudad = 'NATION_11'""")
    on("predicate_variants", """SELECT CASE WHEN a > 0 THEN 'como_se_escribe' WHEN b > 0 THEN 'mayusculas' WHEN c > 0 THEN 'sin_acento'
 WHEN d > 0 THEN 'mayusculas_sin_acento' WHEN f > 0 THEN 'upper_con_acento' WHEN g > 0 THEN 'upper_sin_acento' END AS variante,
 CASE WHEN a > 0 THEN a WHEN b > 0 THEN b WHEN c > 0 THEN c WHEN d > 0 THEN d WHEN f > 0 THEN f ELSE g END AS n FROM (
 SELECT count(*) FILTER (WHERE departamento = 'América') AS a, count(*) FILTER (WHERE departamento = 'AMÉRICA') AS b,
 count(*) FILTER (WHERE departamento = 'America') AS c, count(*) FILTER (WHERE departamento = 'AMERICA') AS d,
 count(*) FILTER (WHERE upper(departamento) = 'AMÉRICA') AS f, count(*) FILTER (WHERE upper(departamento) = 'AMERICA') AS g FROM k)""")
    on("predicate_counts", """SELECT count(*) FILTER (WHERE ciudad = 'NATION_1') AS igual, count(*) FILTER (WHERE upper(ciudad) = 'NATION_1') AS mayusculas,
 count(*) FILTER (WHERE ciudad LIKE '%NATION\\_1%' ESCAPE '\\') AS contiene,
 count(*) FILTER (WHERE departamento = 'ASIA' AND upper(modalidad) LIKE '%DIRECTA%' AND fecha_inicio IS NOT NULL) AS libre FROM k""".replace("\\\\", "\\"))

    on("modality_stats", """SELECT coalesce(nullif(trim(modalidad), ''), '(sin modalidad)') AS modalidad_g, count(*) AS n,
 median(valor_num) FILTER (WHERE valor_num > 0) AS mediana_valor FROM e GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15""")
    on("monthly_series", """SELECT *, row_number() OVER (PARTITION BY departamento ORDER BY anio_mes) AS puesto FROM (
 SELECT departamento, strftime(fecha_inicio, '%Y-%m') AS anio_mes, count(*) AS n_contratos FROM k GROUP BY 1, 2)""")
    on("scatter_sample", f"""SELECT id_contrato, valor_num, duracion_dias, {fixed('valor_num / abs(duracion_dias)')} AS costo_por_dia,
 modalidad, tipo_contrato, nombre_entidad, proveedor FROM e WHERE elegible ORDER BY id_contrato LIMIT 2500""")
    on("cost_per_day_trim", f"SELECT id_contrato, {fixed('costo')} AS costo_por_dia FROM tr", *TRIMMED)
    edge = "(CASE WHEN {i} >= 48 THEN b ELSE {i} * ((b - a) / 48::DOUBLE) + a END)"
    on("cost_histogram", f"""SELECT bin, {fixed('lo')} AS lo, {fixed('hi')} AS hi, {fixed('(lo + hi) / 2')} AS centro, coalesce(n, 0) AS n FROM (
 SELECT bin, {edge.format(i='bin')} AS lo, {edge.format(i='(bin + 1)')} AS hi FROM ends, range(48) r(bin)) LEFT JOIN h USING (bin)""",
       *TRIMMED, "ends AS (SELECT min(costo) AS a, max(costo) AS b FROM tr)",
       "g AS (SELECT costo, a, b, least(47, floor((costo - a) * (48::DOUBLE / (b - a))))::BIGINT AS g FROM tr, ends)",
       f"""h AS (SELECT CASE WHEN costo < {edge.format(i='g')} THEN g - 1 WHEN costo >= {edge.format(i='(g + 1)')} AND g < 47 THEN g + 1 ELSE g END AS bin,
 count(*) AS n FROM g GROUP BY 1)""")
    on("axis_extents", f"""SELECT {fixed('log10(greatest(min(valor_num), 500::DOUBLE))', 8)} AS valor_lo, {fixed('log10(max(valor_num) * 1.2::DOUBLE)', 8)} AS valor_hi,
 {fixed('log10(greatest(min(duracion_dias)::DOUBLE, 1::DOUBLE))', 8)} AS duracion_lo, {fixed('log10(max(duracion_dias) * 1.08::DOUBLE)', 8)} AS duracion_hi FROM pt""", POINTS)
    on("value_labels", f"SELECT id_contrato, {label('valor_num')} AS etiqueta, {label('(valor_num * 1000)')} AS etiqueta_miles, {label('(valor_num * 100000)')} AS etiqueta_cien_miles FROM e")
    on("value_quantiles", f"SELECT a.departamento, {fixed('a.q')} AS p10, {fixed('b.q')} AS p50, {fixed('c.q')} AS p99 FROM a JOIN b USING (departamento) JOIN c USING (departamento)",
       quantile("e", "valor_num", 0.1, "a", "departamento"), quantile("e", "valor_num", 0.5, "b", "departamento"), quantile("e", "valor_num", 0.99, "c", "departamento"))

    on("quantile_sketches", """SELECT ambito, count(*) AS n, cuantil, true AS dentro FROM (SELECT unnest([departamento, '(todo)']) AS ambito
 FROM e WHERE valor_num IS NOT NULL), unnest(['p10', 'p50', 'p90', 'p99']) t(cuantil) GROUP BY ALL""")

    conc = ("ent_t AS (SELECT nit_entidad, count(*) AS contratos_entidad FROM k GROUP BY 1)",
            f"ent_p AS (SELECT {PAIR_KEYS}, count(*) AS contratos_par FROM k GROUP BY ALL)",
            "ci AS (SELECT ent_p.*, contratos_entidad, contratos_par::DOUBLE / contratos_entidad AS idx FROM ent_p JOIN ent_t USING (nit_entidad))")
    out = f"{PAIR_KEYS}, contratos_par, contratos_entidad, {fixed('idx', 8)} AS indice_concentracion"
    on("concentration_index", f"SELECT {out} FROM ci", *conc)
    q["kept_concentration"], q["kept_quality"] = q["concentration_index"], q["quality_summary"]
    on("concentration_top", f"SELECT {out} FROM ci ORDER BY idx DESC, contratos_par DESC, {PAIR_KEYS} LIMIT 30", *conc)
    on("trailing_concentration", f"""SELECT DISTINCT nit_entidad, doc_proveedor, fecha_inicio, contratos_par, contratos_entidad,
 {fixed('contratos_par::DOUBLE / contratos_entidad', 8)} AS indice FROM (SELECT nit_entidad, doc_proveedor, fecha_inicio,
 count(*) OVER (PARTITION BY nit_entidad, doc_proveedor ORDER BY fecha_inicio RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW) AS contratos_par,
 count(*) OVER (PARTITION BY nit_entidad ORDER BY fecha_inicio RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW) AS contratos_entidad FROM k)""")
    on("direct_burst_30d", """SELECT doc_proveedor, count(*) AS n_directos, max(n) AS max_directos_ventana FROM (SELECT doc_proveedor,
 count(*) OVER (PARTITION BY doc_proveedor ORDER BY fecha_inicio RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS n
 FROM e WHERE es_directa = 1) GROUP BY 1 HAVING max(n) >= 2""")
    on("direct_ratio", f"""SELECT nit_entidad, {fixed('d', 2)} AS valor_directo, {fixed('c', 2)} AS valor_competitivo,
 {fixed('CASE WHEN c <> 0 THEN d / c END')} AS ratio_directa FROM (SELECT nit_entidad,
 coalesce(sum(valor_num) FILTER (WHERE es_directa = 1), 0::DOUBLE) AS d, coalesce(sum(valor_num) FILTER (WHERE es_directa = 0), 0::DOUBLE) AS c
 FROM e WHERE flag_valor_invalido = 0 GROUP BY 1)""")
    on("relationship_age", """SELECT id_contrato, primer_contrato, date_diff('day', primer_contrato, fecha_inicio) AS antiguedad_dias FROM (
 SELECT id_contrato, fecha_inicio, min(fecha_inicio) OVER (PARTITION BY doc_proveedor) AS primer_contrato FROM k)""")
    q["sigma_outliers"] = f"""SELECT event_id, event_type, value, {fixed('media')} AS media FROM (SELECT event_id, event_type, value,
 avg(value) OVER (PARTITION BY event_type) AS media, stddev_samp(value) OVER (PARTITION BY event_type) AS sd FROM events) WHERE value > media + 3 * sd"""
    on("sigma_outliers_contracts", """SELECT id_contrato, tipo_contrato, valor_num FROM (SELECT *, avg(valor_num) OVER (PARTITION BY tipo_contrato) AS media,
 stddev_samp(valor_num) OVER (PARTITION BY tipo_contrato) AS sd FROM e WHERE flag_valor_invalido = 0) WHERE valor_num > media + 1.6::DOUBLE * sd""")
    on("sector_deviation", f"""SELECT id_contrato, tipo_contrato, {fixed('100::DOUBLE * (valor_num / q - 1)')} AS desviacion_pct
 FROM val JOIN md USING (tipo_contrato)""", "val AS (SELECT * FROM e WHERE flag_valor_invalido = 0)", quantile("val", "valor_num", 0.5, "md", "tipo_contrato"))
    on("modality_risk", """SELECT id_contrato, modalidad, es_directa, CASE WHEN strip_accents(upper(modalidad)) LIKE '%DIRECTA%' THEN 10
 WHEN strip_accents(upper(modalidad)) LIKE '%ABREVIADA%' THEN 5 WHEN strip_accents(upper(modalidad)) LIKE '%LICITACION PUBLICA%' THEN 1 END AS puntuacion_modalidad FROM e""")

    on("by_department", "SELECT *, row_number() OVER (ORDER BY n_contratos DESC, departamento NULLS LAST) AS puesto FROM por_depto", SPELLED)
    on("by_city", "SELECT *, row_number() OVER (PARTITION BY departamento ORDER BY n_contratos DESC, ciudad NULLS LAST) AS puesto FROM por_ciudad", SPELLED)
    on("city_list", """SELECT *, row_number() OVER (PARTITION BY departamento ORDER BY n_contratos DESC, ciudad) AS puesto,
 count(*) OVER (PARTITION BY departamento) AS n_ciudades FROM (
 SELECT departamento, coalesce(nullif(trim(ciudad), ''), '(vacío / null)') AS ciudad, count(*) AS n_contratos FROM sp GROUP BY 1, 2)""", SPELLED)
    rank_label = """CASE WHEN lower(trim(departamento)) IN ('', 'nan', 'none') THEN '(Sin nombre)'
 WHEN lower(departamento) LIKE '%distrito capital%' OR lower(departamento) LIKE '%bogot%' THEN 'Bogotá (D.C.)' ELSE trim(departamento) END AS etiqueta"""
    on("department_rank", f"SELECT *, {rank_label} FROM por_depto", SPELLED)
    region_pairs = "rp AS (SELECT DISTINCT trim(departamento) AS departamento, trim(ciudad) AS ciudad FROM sp WHERE trim(departamento) <> '' AND trim(ciudad) <> '')"
    on("region_pairs", "SELECT * FROM rp", SPELLED, region_pairs)
    on("region_catalog", "SELECT departamento, count(*) AS n_ciudades, string_agg(ciudad, '|' ORDER BY lower(ciudad), ciudad) AS ciudades FROM rp GROUP BY 1", SPELLED, region_pairs)
    on("region_catalog_saved", """SELECT departamento, ciudad, row_number() OVER (PARTITION BY departamento ORDER BY lower(ciudad), ciudad) - 1 AS orden,
 'csv' AS origen FROM rp""", SPELLED, region_pairs)
    for source in ("api", "json"):
        q[f"region_catalog_{source}"] = q["region_catalog_saved"].replace("'csv' AS origen", f"'{source}' AS origen")
    md = matched("por_depto", "md")
    on("region_match", "SELECT * FROM md", SPELLED, md)
    q["region_match_collated"] = q["region_match"]
    on("region_fill", "SELECT orden, d.dpto, coalesce(n, 0)::DOUBLE AS z FROM deptos d LEFT JOIN (SELECT dpto, sum(n_contratos) AS n FROM md GROUP BY 1) USING (dpto)", SPELLED, md)
    q["region_fill_geojson"] = q["region_fill"]
    on("region_unmatched", "SELECT departamento, n_contratos FROM md WHERE dpto IS NULL", SPELLED, md)
    city_ctes = (SPELLED, matched("por_ciudad", "pc"), CITIES, tiers("ciudades", "cm"))
    on("city_tier_match", "SELECT * FROM cm", *city_ctes)
    q["city_tier_index"] = q["city_tier_match"]
    on("municipality_volumes", "SELECT dpto, mpio, sum(n_contratos)::BIGINT AS n_contratos, first(ciudad ORDER BY n_contratos DESC, ciudad) AS ciudad FROM cm GROUP BY 1, 2", *city_ctes)
    on("municipality_fill", """SELECT dpto, mpio, coalesce(n_contratos, 0)::DOUBLE AS z, coalesce(ciudad, ciudad_catalogo, '') AS ciudad_filtro,
 CASE WHEN coalesce(ciudad, ciudad_catalogo, '') <> '' THEN coalesce(ciudad, ciudad_catalogo) ELSE mpio END AS etiqueta,
 row_number() OVER (PARTITION BY dpto ORDER BY mpio) AS puesto
 FROM mapa LEFT JOIN vol USING (dpto, mpio) LEFT JOIN cat1 USING (dpto, mpio)""",
       SPELLED, """pd AS (SELECT departamento, trim(ciudad) AS ciudad, count(*) AS n_contratos FROM sp GROUP BY 1, 2)""", matched("pd", "pdm"),
       "pdc AS (SELECT dpto, ciudad, n_contratos FROM pdm WHERE dpto IS NOT NULL)", tiers("pdc", "cm"),
       "vol AS (SELECT dpto, mpio, sum(n_contratos) AS n_contratos, first(ciudad ORDER BY n_contratos DESC, ciudad) AS ciudad FROM cm GROUP BY 1, 2)",
       region_pairs, "rpo AS (SELECT *, row_number() OVER (PARTITION BY departamento ORDER BY lower(ciudad), ciudad) - 1 AS orden FROM rp)",
       matched("rpo", "rpm"), "rpc AS (SELECT dpto, ciudad, orden FROM rpm WHERE dpto IS NOT NULL)",
       tiers("(SELECT DISTINCT dpto, ciudad FROM rpc)", "ct"),
       "cat1 AS (SELECT dpto, mpio, first(ciudad ORDER BY orden, ciudad) AS ciudad_catalogo FROM rpc JOIN ct USING (dpto, ciudad) GROUP BY 1, 2)")
    q["municipality_fill_geojson"] = q["municipality_fill"]
    on("csv_result", "SELECT * FROM por_depto", SPELLED)
    on("saved_runs", """SELECT strftime(fecha_inicio, '%Y-%m') AS anio_mes, count(*) AS n_contratos, departamento AS region, 2::BIGINT AS version
 FROM k GROUP BY 1, 3""")
    q["csv_records"] = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'línea uno' || chr(10) || 'línea "dos", fin'
 WHEN o_orderkey % 17 = 0 THEN 'a 5" b' WHEN o_orderkey % 19 = 0 THEN 'x" y' ELSE 'z' END AS nota,
 CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus WHEN o_orderkey % 13 = 0 THEN 'de más' END AS estado,
 (o_orderkey % 11 = 0) <> (o_orderkey % 13 = 0) AS rechazado FROM orders"""
    q["tsv_headings"] = "SELECT o_orderkey AS clave, o_orderpriority AS prioridad, strftime(o_orderdate, '%Y-%m-%d') AS fecha, false AS rechazado FROM orders"
    on("department_volume", f"""SELECT nombre, coalesce((SELECT sum(n_contratos) FROM por_depto WHERE departamento = trim(nombre)),
 (SELECT max(n_contratos) FROM por_depto WHERE {norm('departamento')} = {norm('nombre')}), 0)::BIGINT AS n_contratos
 FROM (SELECT dpto AS nombre FROM deptos UNION ALL SELECT 'Zona ' || lower(dpto) FROM deptos)""", SPELLED)
    on("normalized_names", f"""SELECT departamento, ciudad, count(*) AS n, {norm("departamento || '   ' || ciudad")} AS clave, {rank_label}
 FROM sp GROUP BY departamento, ciudad""", SPELLED)

    on("burst_window", trailing("e", "nit_entidad, doc_proveedor", "fecha_inicio", 60, "NOT descartado"))
    q["burst_window_hot"] = q["stream_burst_exact"] = q["burst_window"]
    on("burst_max", "SELECT * FROM pico", pairs(60))
    on("burst_window_nation", trailing("k", "ciudad, doc_proveedor", "fecha_inicio", 10))
    q["burst_window_events"] = trailing("events", "user_id, event_type", "ts", 2)
    on("pair_features_60d", f"SELECT {PAIR_OUT} FROM pares", pairs(60))
    flags = ", ".join(r for r, _, _, _ in RULES)
    objects = "count(*) AS n, count(DISTINCT trim(coalesce(objeto_raw, ''))[1:50]) AS exacto, true AS dentro FROM e WHERE NOT descartado GROUP BY ALL"
    on("pair_diversity_sketch", f"SELECT 'par' AS ambito, nit_entidad, doc_proveedor, {objects} UNION ALL SELECT 'proveedor', NULL, doc_proveedor, {objects}")
    on("rule_scores", f"SELECT {PAIR_KEYS}, {flags}, round(score_reglas, 2) AS score_reglas, reglas_disparadas FROM puntos", pairs(60), *SCORED)
    on("rule_firing", "\nUNION ALL ".join(
        f"SELECT '{r}' AS regla, {w}::DOUBLE AS peso, '{t}' AS descripcion, (SELECT count(*) FROM puntos WHERE {r}) AS n_pares" for r, w, t, _ in RULES), pairs(60), *SCORED)
    threshold = quantile("puntos", "score_reglas", 0.95, "um")
    on("rules_ranking", f"""SELECT {PAIR_KEYS}, n_contratos, {fixed('suma_valor', 2)} AS suma_valor, {fixed('ratio_directa')} AS ratio_directa,
 {fixed('concentracion_entidad', 8)} AS concentracion_entidad, max_contratos_ventana, {fixed('score_reglas')} AS score_final,
 {fixed('score_reglas')} AS score_reglas, 0::DOUBLE AS score_anomalia, reglas_disparadas,
 CASE WHEN frases <> '' THEN frases ELSE format('combinación de scores (reglas={{:.2f}}, anomalía={{:.2f}})', score_reglas, 0::DOUBLE) END AS razon_priorizacion,
 true AS alerta FROM puntos, um WHERE score_reglas >= q""", pairs(60), *SCORED, threshold)
    mix = """mezcla AS (SELECT *, least(1::DOUBLE, greatest(0::DOUBLE, 0.4::DOUBLE * score_reglas + 0.6::DOUBLE * azar)) AS final,
 concat_ws('; ', nullif(frases, ''), CASE WHEN azar >= 0.7::DOUBLE THEN 'patrón agregado atípico (Isolation Forest)' END) AS motivos FROM (
 SELECT *, ('0x' || substr(md5(concat_ws('|', nit_entidad, doc_proveedor)), 1, 4))::INT::DOUBLE / 65536::DOUBLE AS azar FROM puntos))"""
    on("blended_ranking", f"""SELECT {PAIR_KEYS}, n_contratos, {fixed('suma_valor', 2)} AS suma_valor, {fixed('ratio_directa')} AS ratio_directa,
 {fixed('concentracion_entidad', 8)} AS concentracion_entidad, max_contratos_ventana, {fixed('final')} AS score_final,
 {fixed('score_reglas')} AS score_reglas, {fixed('azar')} AS score_anomalia, reglas_disparadas,
 CASE WHEN motivos <> '' THEN motivos ELSE format('combinación de scores (reglas={{:.2f}}, anomalía={{:.2f}})', score_reglas, azar) END AS razon_priorizacion,
 true AS alerta FROM mezcla, um WHERE final >= q""", pairs(60), *SCORED, mix, quantile("mezcla", "final", 0.95, "um"))
    on("run_counts_rules", f"""SELECT c.*, (SELECT count(*) FROM pares) AS n_pairs, (SELECT count(*) FROM puntos) AS n_pairs_scored,
 (SELECT count(*) FROM puntos, um WHERE score_reglas >= q) AS n_alerts, {fixed('(SELECT q FROM p90)')} AS costo_dia_p90,
 95::DOUBLE AS alert_percentile, 1::DOUBLE AS weight_rules, 0::DOUBLE AS weight_if, 60 AS burst_window_days,
 2 AS burst_min_contracts, 2 AS min_pair_contracts,
 {fixed('(SELECT count(*) FROM puntos, um WHERE score_reglas >= q)::DOUBLE / (SELECT count(*) FROM puntos)', 8)} AS tasa_alerta
 FROM (SELECT {POPULATION} FROM e) c""", pairs(60), *SCORED, threshold)
    on("pair_model_features", f"""SELECT {PAIR_KEYS}, {fixed('ln(1 + n_contratos::DOUBLE)')} AS log_n_contratos, {fixed('ln(1 + suma_valor)')} AS log_suma_valor,
 {fixed('ln(1 + promedio_valor)')} AS log_promedio_valor, {fixed('ratio_directa')} AS f_ratio_directa, {fixed('concentracion_entidad')} AS f_concentracion,
 {fixed('max_contratos_ventana::DOUBLE')} AS f_ventana, {fixed('ln(1 + coalesce(costo_dia_promedio, 0))')} AS log_costo_dia,
 {fixed('ln(1 + coalesce(duracion_promedio, 0))')} AS log_duracion, {fixed('diversidad_objetos::DOUBLE')} AS f_diversidad,
 {fixed('pct_objeto_corto')} AS f_objeto_corto, {fixed('1 - least(1::DOUBLE, greatest(0::DOUBLE, diversidad_objetos::DOUBLE / n_contratos))')} AS repeticion_objeto FROM pares""", pairs(60))

    on("csv_ingest", """SELECT departamento, anio, 'Activo' AS "Estado", count(*) AS n, count(DISTINCT id_contrato) AS n_ids, sum(longitud_objeto)::BIGINT AS texto,
 sum(duracion_dias)::BIGINT AS dias, sum(valor_num::DECIMAL(18,2))::DOUBLE AS valor, max(fecha_fin) AS ultimo_fin FROM e GROUP BY 1, 2""")
    on("json_pages", "SELECT departamento, count(*) AS n, min(fecha_inicio) AS primera, max(fecha_inicio) AS ultima FROM k GROUP BY 1")
    q["timestamp_texts"] = """SELECT event_id, CASE event_type WHEN 'click' THEN date_trunc('millisecond', ts) WHEN 'view' THEN date_trunc('second', ts)
 WHEN 'signup' THEN date_trunc('day', ts)::TIMESTAMP WHEN 'error' THEN date_trunc('day', ts)::TIMESTAMP END AS leido FROM events"""

    bad = "SELECT id_contrato AS id, 'valor' AS columna, valor, 'no convertible' AS motivo FROM tx WHERE TRY_CAST(valor AS DOUBLE) IS NULL"
    on("cast_errors", bad, VALOR_TEXT)
    on("cast_error_counts", f"SELECT columna, motivo, count(*) AS n FROM ({bad}) GROUP BY 1, 2", VALOR_TEXT)
    on("cast_rows", "SELECT id_contrato, CAST(valor AS DOUBLE) AS valor FROM tx WHERE TRY_CAST(valor AS DOUBLE) IS NOT NULL", VALOR_TEXT)
    kinds = {"o_orderkey": "number", "o_custkey": "number", "o_totalprice": "number", "o_orderdate": "fixed_timestamp",
             "o_orderstatus": "text", "o_orderpriority": "text"}
    typed = "\nUNION ALL ".join(
        f"SELECT '{c}', CASE WHEN count({c}) = count(TRY_CAST({c}::VARCHAR AS DOUBLE)) THEN 'number'"
        f" WHEN count({c}) = count(TRY_CAST({c}::VARCHAR AS TIMESTAMP)) THEN 'fixed_timestamp' ELSE 'text' END FROM orders" for c in kinds)
    q["guessed_types"] = f"SELECT columna, tipo FROM ({typed} UNION ALL SELECT 'caro', 'checkbox' UNION ALL SELECT 'vacia', 'text') t(columna, tipo)"
    check = """SELECT sum(n)::BIGINT AS n_filas, coalesce(sum(n) FILTER (WHERE id IS NULL), 0)::BIGINT AS n_nulos,
 count(*) FILTER (WHERE id IS NOT NULL AND n > 1) AS n_repetidos, count(*) FILTER (WHERE id IS NULL OR n > 1) = 0 AS valido, '{c}' AS columna
 FROM (SELECT {id} AS id, count(*) AS n FROM {t} GROUP BY 1)"""
    q["row_id_check"] = check.format(c="linea", id="concat_ws('-', l_orderkey, l_linenumber)", t="lineitem") + " UNION ALL " + check.format(c="orden", id="o_orderkey", t="orders")
    q["upsert"] = with_(CHANGES, select=f"SELECT o_orderkey, o_orderstatus, {fixed('o_totalprice', 2)} AS o_totalprice FROM nueva")
    q["replace_delete"] = with_(CHANGES, select=f"""SELECT o_orderkey, o_orderstatus, {fixed('o_totalprice', 2)} AS o_totalprice FROM nueva
 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM bajas)""")
    q["upsert_buckets"] = q["replace_delete"]
    on("load_stats", f"""SELECT (SELECT count(*) FROM ({bad})) AS errores,
 (SELECT count(*) FROM cambios WHERE o_orderkey NOT IN (SELECT o_orderkey FROM base)) AS filas_creadas,
 (SELECT count(*) FROM cambios WHERE o_orderkey IN (SELECT o_orderkey FROM base)) AS filas_actualizadas,
 (SELECT count(*) FROM base WHERE o_orderkey IN (SELECT o_orderkey FROM bajas) AND o_orderkey NOT IN (SELECT o_orderkey FROM cambios)) AS filas_borradas""",
       VALOR_TEXT, CHANGES)
    q["saved_transform_file"] = q["upsert"]
    q["last_change"] = "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
    q["saved_transform"] = "SELECT o_totalprice AS precio, o_orderkey AS id, lower(o_orderstatus) AS o_orderstatus, o_orderpriority, o_totalprice >= 200000 AS caro FROM orders"
    q["sorted_page"] = "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 500 OFFSET 100"

    q["stream_daily_counts"] = """SELECT desde, desde + INTERVAL 1 DAY AS hasta, event_type, n FROM (
 SELECT date_trunc('day', ts)::TIMESTAMP AS desde, event_type, count(*) AS n FROM events GROUP BY 1, 2)"""
    on("stream_burst", """SELECT desde, desde + INTERVAL 10 DAY AS hasta, ciudad, doc_proveedor, count(*) AS n FROM (
 SELECT date_trunc('day', fecha_inicio)::TIMESTAMP - to_days(i::INT) AS desde, ciudad, doc_proveedor FROM k, range(10) r(i))
 GROUP BY ALL HAVING count(*) >= 3""")
    q["stream_sessions"] = """SELECT min(ts) AS desde, max(ts) + INTERVAL 6 HOUR AS hasta, user_id, count(*) AS n FROM (
 SELECT user_id, ts, sum(nueva) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
 SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nueva FROM events))
 GROUP BY user_id, s"""
    q["stream_repeats"] = "SELECT event_id, user_id, event_type, value FROM events"
    q["stream_repeats_ever"] = q["stream_repeats"]
    return q


ORACLES = _sql()
