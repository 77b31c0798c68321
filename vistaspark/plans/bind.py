"""Role binding: the driver's star-schema tables seen as clinical tables.

Each role is declared once as a list of SQL expressions that both Spark SQL and DuckDB
accept, so the Spark side (``Tables``) and the oracle side (``with_roles``) read the
very same projection. A role is a plain projection over one parquet scan (``camas`` adds
two small dimension joins), so Catalyst still prunes columns and pushes filters into the
scan through it.

Binding (clinical role <- table):

* pacientes   <- customer   (patient; area = market segment)
* atencion    <- orders     (attention / exam header; status O = ABIERTA, else CERRADA)
* cargos      <- lineitem   (charge / exam detail; state N PENDIENTE, R CANCELADO, A REALIZADO)
* catalogo    <- part       (exam catalogue)
* camas       <- supplier + nation + region (bed; area = region name; flag = negative balance)
* signos      <- events     (vital sign / audit log)
* diagnosticos<- documents  (diagnosis text)
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Reference dates: never ``current_date()`` inside an operator, so results repeat.
AS_OF_ORDERS = "2001-12-01"
AS_OF_EVENTS = "2024-01-31"

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# role -> (base table, projection); every expression is valid in Spark SQL and DuckDB
ROLES: dict[str, tuple[str, list[str]]] = {
    "pacientes": ("customer", [
        "c_custkey AS Id_exp",
        "c_name AS nombre",
        "c_mktsegment AS area",
        "c_nationkey AS id_nacion",
        "c_acctbal AS saldo",
    ]),
    "atencion": ("orders", [
        "o_orderkey AS id_atencion",
        "o_custkey AS Id_exp",
        "CASE WHEN o_orderstatus = 'O' THEN 'ABIERTA' ELSE 'CERRADA' END AS status",
        "o_orderstatus AS estado_origen",
        "CAST(o_orderdate AS DATE) AS fecha_ing",
        "o_orderpriority AS especialidad",
        "o_totalprice AS monto",
    ]),
    "cargos": ("lineitem", [
        "l_orderkey AS id_atencion",
        "l_linenumber AS linea",
        "l_partkey AS id_catalogo",
        "l_suppkey AS id_medico",
        "l_quantity AS cantidad",
        "l_extendedprice AS subtotal",
        "CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS precio",
        "l_discount AS descuento",
        "l_tax AS impuesto",
        "l_returnflag AS tipo",
        "CASE l_returnflag WHEN 'N' THEN 'PENDIENTE' WHEN 'R' THEN 'CANCELADO' ELSE 'REALIZADO' END AS estado",
        "l_linestatus AS linestatus",
        "CAST(l_shipdate AS DATE) AS fecha",
    ]),
    "catalogo": ("part", [
        "p_partkey AS id_catalogo",
        "p_name AS nombre",
        "p_brand AS marca",
        "p_type AS tipo",
        "p_size AS tamano",
        "p_retailprice AS precio",
    ]),
    "signos": ("events", [
        "event_id AS id_signo",
        "ts AS fecha",
        "user_id AS id_usuario",
        "event_type AS signo",
        "value AS valor",
        "props",
    ]),
    "diagnosticos": ("documents", [
        "doc_id AS id_diagnostico",
        "text AS texto",
        "lang",
        "source AS fuente",
        "n_chars",
    ]),
}

_CAMAS_SQL = (
    "SELECT s.s_suppkey AS id_cama, s.s_name AS numero, s.s_nationkey AS id_nacion, "
    "n.n_name AS nacion, r.r_name AS area, "
    "CASE WHEN s.s_acctbal < 0 THEN 1 ELSE 0 END AS ocupada, s.s_acctbal AS saldo "
    "FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey "
    "LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"
)


def role_sql(name: str) -> str:
    if name == "camas":
        return _CAMAS_SQL
    table, exprs = ROLES[name]
    return f"SELECT {', '.join(exprs)} FROM {table}"


def with_roles(*names: str) -> str:
    """``WITH role AS (...), ...`` prefix for an oracle query (no trailing comma)."""
    return "WITH " + ",\n".join(f"{n} AS ({role_sql(n)})" for n in names)


@dataclass
class Tables:
    """Lazily bound role DataFrames over one scale-factor folder."""

    spark: SparkSession
    root: str
    _cache: dict = field(default_factory=dict)

    def raw(self, name: str) -> DataFrame:
        key = ("raw", name)
        if key not in self._cache:
            self._cache[key] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._cache[key]

    def role(self, name: str) -> DataFrame:
        key = ("role", name)
        if key not in self._cache:
            if name == "camas":
                s = self.raw("supplier")
                n = self.raw("nation")
                r = self.raw("region")
                # nation/region are fixed-size dimensions (25 / 5 rows): broadcast is bounded
                df = (
                    s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left")
                    .join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")
                    .select(
                        s.s_suppkey.alias("id_cama"),
                        s.s_name.alias("numero"),
                        s.s_nationkey.alias("id_nacion"),
                        n.n_name.alias("nacion"),
                        r.r_name.alias("area"),
                        F.when(s.s_acctbal < 0, 1).otherwise(0).alias("ocupada"),
                        s.s_acctbal.alias("saldo"),
                    )
                )
            else:
                table, exprs = ROLES[name]
                df = self.raw(table).selectExpr(*exprs)
            self._cache[key] = df
        return self._cache[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in ROLES or name == "camas":
            return self.role(name)
        if name in BASE_TABLES:
            return self.raw(name)
        raise AttributeError(name)
