"""Flow, alert, packet and scored views derived from the generic test tables.

Each view exists twice: as a DataFrame (``Tables``) and as a SQL common table expression
(``VIEW_SQL``) for the twin queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions import alerts as A
from flowlens.functions import labels as L

_RESP_PORTS = {"view": 80, "click": 443, "purchase": 8000, "signup": 22, "error": 53}
_LABELS = {"view": "BENIGN", "click": "DoS Hulk", "purchase": "PortScan",
           "signup": "FTP-Patator", "error": "DDoS"}
_SOURCES = ["default", "reference", "uploaded"]
_HISTORIES = ["ShADadFf", "S", "ShAPpDadR", "UuEe-", "ShADPPa"]

# Texts a reader meets in real files, picked by event number.
PROTO_TEXTS = ["6", "17", "1", "TCP", " udp ", "http", "dns", "", "gre"]
LABEL_TEXTS = [
    "BENIGN", "DoS Hulk", "Web Attack – XSS", "Web Attack � Brute Force",
    "Web  Attack - Sql Injection", "PortScan", "Port Scan", "Bot", "SSH-Patator",
    "Heartbleed", "DDoS", " Infiltration ",
]
KDD_TEXTS = ["normal.", "smurf.", " Neptune ", "guess_passwd.", "rootkit..", "unknown."]
ATTACK_TEXTS = ["ddos", "Brute Force", "brute_force", "PORT_SCAN", "Benign", "bot", "nonsense"]


def pick(texts: list[str], number: Column) -> Column:
    """One of the texts by number, in turn."""
    return F.get(F.array(*[F.lit(t) for t in texts]), F.pmod(number, F.lit(len(texts))).cast("int"))


def pick_sql(texts: list[str], number: str) -> str:
    items = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"list_extract([{items}], CAST({number} % {len(texts)} AS INTEGER) + 1)"


def case_sql(table: dict, expr: str, default: str = "NULL") -> str:
    """A fixed table as a CASE expression."""
    def value(v) -> str:
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    arms = " ".join(f"WHEN {value(k)} THEN {value(v)}" for k, v in table.items())
    return f"CASE {expr} {arms} ELSE {default} END"


def _turn(options: list[Column]) -> Column:
    """One of the columns by event number, in turn."""
    out = options[-1]
    for i, option in enumerate(options[:-1]):
        out = F.when(F.col("event_id") % len(options) == i, option).otherwise(out)
    return out


def _time_text() -> Column:
    """The time in one of eight spellings."""
    return _turn([
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.date_format("ts", "M/d/yyyy H:mm"),
        F.date_format("ts", "MM/dd/yyyy HH:mm:ss"),
        F.date_format("ts", "MM/dd/yyyy hh:mm:ss a"),
        F.unix_seconds("ts").cast("string"),
        F.lit("garbage"),
        F.date_format("ts", "yyyy-MM-dd"),
    ])


def with_scores(df: DataFrame) -> DataFrame:
    """Add true and predicted class and a probability array to rows with event number and k."""
    n, k = F.col("event_id"), F.col("k")
    truth = (n % 6).cast("int")
    wrong = ((truth + 1) % 6).cast("int")
    rows = df.withColumns({"y_true": truth, "y_pred": F.when(k < 80, truth).otherwise(wrong)})
    # Graded probabilities: ties and many distinct values both occur.
    half, grade = F.lit(0.5), k / F.lit(400.0)
    return rows.withColumn("probabilities", F.array(*[
        F.when(F.col("y_pred") == i, half + grade).otherwise((half - grade) / F.lit(5.0)) for i in range(6)
    ]))


class Tables:
    """The test tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.table("events").withColumns({"k": k, "ts": F.col("ts").cast("timestamp")})

    def conn(self) -> DataFrame:
        n, k, kind = F.col("event_id"), F.col("k"), F.col("event_type")

        def by_type(table: dict) -> Column:
            value = F.lit(None)
            for name, v in table.items():
                value = F.when(kind == name, F.lit(v)).otherwise(value)
            return value

        proto = F.when(n % 4 == 0, "udp").when(n % 4 == 1, "icmp").otherwise("tcp")
        return self.events().select(
            n, "user_id",
            F.concat(F.lit("C"), n.cast("string")).alias("uid"),
            "ts",
            (F.unix_micros("ts") / F.lit(1e6)).alias("ts_epoch"),
            F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string")).alias("id_orig_h"),
            (F.lit(1024) + n % 60000).cast("int").alias("id_orig_p"),
            F.concat(F.lit("192.168.0."), (n % 20).cast("string")).alias("id_resp_h"),
            by_type(_RESP_PORTS).alias("id_resp_p"),
            proto.alias("proto"),
            F.when(kind == "view", "http").otherwise("-").alias("service"),
            F.col("value").alias("duration"),
            F.floor(F.col("value") * F.lit(100.0)).alias("orig_bytes"),
            (k * 10).cast("bigint").alias("resp_bytes"),
            (k % 10).cast("bigint").alias("orig_pkts"),
            (n % 7).alias("resp_pkts"),
            F.when(n % 7 == 0, "S0").otherwise("SF").alias("conn_state"),
            pick(_HISTORIES, n).alias("history"),
            F.when(n % 2 == 0, F.floor(F.col("value") * F.lit(100.0)) + 20).alias("orig_ip_bytes"),
            F.when(n % 3 == 0, (k * 10 + 40).cast("bigint")).alias("resp_ip_bytes"),
            by_type(_LABELS).alias("label"),
            (k / F.lit(100.0)).alias("model_score"),
            k,
        )

    def alerts(self) -> DataFrame:
        n, attack = F.col("event_id"), F.col("attack_type")
        meta = F.concat(
            F.lit('{"k": '), F.col("k").cast("string"), F.lit(', "dataset_source": "'),
            pick(_SOURCES, n), F.lit('"'),
            F.when(n % 4 == 0, F.lit("")).otherwise(
                F.concat(F.lit(', "dataset_label": "'), F.col("label"), F.lit('"'))),
            F.lit("}"),
        )
        # The attack type is a column of its own first: later uses do not repeat its table.
        return self.conn().withColumn("attack_type", L.label_to_attack("label")).select(
            F.md5("uid").alias("id"),
            F.col("ts").alias("timestamp"),
            F.timestamp_micros(F.unix_micros("ts") + F.col("k") * F.lit(1000)).alias("ingested_at"),
            A.severity("model_score", attack).alias("severity"),
            "attack_type",
            F.col("id_orig_h").alias("src_ip"),
            F.col("id_orig_p").alias("src_port"),
            F.col("id_resp_h").alias("dst_ip"),
            F.col("id_resp_p").alias("dst_port"),
            L.alert_protocol("proto", numbers=False).alias("protocol"),
            F.concat(F.lit("ZEEK-"), F.col("uid")).alias("rule_id"),
            F.concat(F.lit("Zeek "), attack).alias("rule_name"),
            "model_score",
            A.label_from_score("label", "model_score").alias("model_label"),
            meta.alias("meta"),
        )

    def cic(self) -> DataFrame:
        """Flow labels of the longer connections; the very long ones are listed twice."""
        rows = self.conn().filter("duration >= 5").select(
            "duration",
            L.flow_id("id_orig_h", "id_resp_h", "id_orig_p", "id_resp_p", "proto").alias("flow_id"),
            F.col("label").alias("Label"),
            F.to_date("ts").alias("day"),
        )
        copies = F.when(F.col("duration") >= 50, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        return rows.withColumn("copy", F.explode(copies)).drop("copy", "duration")

    def packets(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").cast("string").alias("uid"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            (F.col("l_linenumber") % 2 == 1).alias("is_orig"),
            F.when(F.col("l_returnflag") == "R", "PA").otherwise("A").alias("flags"),
            F.floor("l_quantity").alias("len"),
        )

    def scored(self) -> DataFrame:
        """True and predicted class with a probability array."""
        return with_scores(self.events().select("event_id", "k"))

    def dirty(self) -> DataFrame:
        """Text columns as met in files."""
        n, k = F.col("event_id"), F.col("k")
        v = F.col("value").cast("string")
        number = [
            F.lit("-"), F.concat(F.lit("  "), v, F.lit(" ")),
            F.concat(F.lit("1,"), F.lpad(k.cast("string"), 3, "0"), F.lit(".5")),
            F.lit("NaN"), F.lit(""), F.lit("-inf"), F.concat(F.lit("x"), v), v,
        ]
        return self.events().select(
            n, k, "ts", "value", _turn(number).alias("num_text"), _time_text().alias("ts_text"),
            pick(PROTO_TEXTS, n).alias("proto_text"), pick(LABEL_TEXTS, n).alias("label_text"),
            pick(KDD_TEXTS, n).alias("kdd_text"), pick(ATTACK_TEXTS, n).alias("attack_text"),
        )

    def raw_flows(self) -> DataFrame:
        """Flow rows as in the raw files: text columns, some unusable."""
        n = F.col("event_id")
        flows = self.conn().withColumns({"ts_text": _time_text(), "label_text": pick(LABEL_TEXTS, n)})
        return flows.select(
            n,
            L.flow_id("id_orig_h", "id_resp_h", "id_orig_p", "id_resp_p", "proto").alias("Flow ID"),
            F.col("id_orig_h").alias("Source IP"),
            F.when(F.col("k") == 13, "n/a").otherwise(F.col("id_orig_p").cast("string")).alias("Source Port"),
            F.when(F.col("k") == 11, "").otherwise(F.col("id_resp_h")).alias("Destination IP"),
            F.col("id_resp_p").cast("string").alias("Destination Port"),
            pick(PROTO_TEXTS, n).alias("Protocol"),
            F.col("ts_text").alias("Timestamp"),
            F.floor(F.col("duration") * F.lit(1e6)).cast("string").alias("Flow Duration"),
            F.col("orig_pkts").cast("string").alias("Total Fwd Packets"),
            F.col("resp_pkts").cast("string").alias("Total Backward Packets"),
            F.col("orig_bytes").cast("string").alias("Total Length of Fwd Packets"),
            F.col("resp_bytes").cast("string").alias("Total Length of Bwd Packets"),
            F.col("label_text").alias("Label"),
        )


# --- SQL twins of the views ------------------------------------------------------

SEVERITY_SQL = """list_extract(['Low','Medium','High','Critical'], 1 + greatest(
  CASE WHEN {score} >= 0.9 THEN 3
       WHEN {score} >= 0.75 OR {attack} IN ('DOS','DDOS','BRUTE_FORCE','BOT') THEN 2
       WHEN {score} >= 0.4 OR {attack} = 'PORTSCAN' THEN 1 ELSE 0 END,
  CASE {attack} WHEN 'BENIGN' THEN 0 WHEN 'PORTSCAN' THEN 1 WHEN 'DOS' THEN 1
       WHEN 'DDOS' THEN 3 WHEN 'BRUTE_FORCE' THEN 2 WHEN 'BOT' THEN 3 ELSE 0 END))"""

_NUM_SQL = """CASE event_id % 8 WHEN 0 THEN '-' WHEN 1 THEN '  ' || value || ' '
  WHEN 2 THEN '1,' || lpad(CAST(k AS VARCHAR), 3, '0') || '.5' WHEN 3 THEN 'NaN' WHEN 4 THEN ''
  WHEN 5 THEN '-inf' WHEN 6 THEN 'x' || value ELSE CAST(value AS VARCHAR) END"""
_TIME_SQL = """CASE event_id % 8 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') WHEN 2 THEN strftime(ts, '%-m/%-d/%Y %-H:%M')
  WHEN 3 THEN strftime(ts, '%m/%d/%Y %H:%M:%S') WHEN 4 THEN strftime(ts, '%m/%d/%Y %I:%M:%S %p')
  WHEN 5 THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR) WHEN 6 THEN 'garbage'
  ELSE strftime(ts, '%Y-%m-%d') END"""
# What the texts above mean, in epoch microseconds.
TIME_MEANING_SQL = """CASE event_id % 8 WHEN 1 THEN epoch_us(ts) WHEN 2 THEN epoch_us(date_trunc('minute', ts))
  WHEN 6 THEN NULL WHEN 7 THEN epoch_us(CAST(date_trunc('day', ts) AS TIMESTAMP))
  ELSE epoch_us(date_trunc('second', ts)) END"""
FLOW_ID_SQL = """id_orig_h || '-' || id_resp_h || '-' || id_orig_p || '-' || id_resp_p || '-' ||
  CASE proto WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 WHEN 'icmp' THEN 1 ELSE 0 END"""

VIEW_SQL = {
    "ev": """ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "conn": f"""conn AS (SELECT event_id, user_id, 'C' || event_id AS uid, ts,
  epoch_us(ts) / CAST(1000000 AS DOUBLE) AS ts_epoch,
  '10.0.0.' || (user_id % 50) AS id_orig_h, CAST(1024 + event_id % 60000 AS INTEGER) AS id_orig_p,
  '192.168.0.' || (event_id % 20) AS id_resp_h,
  {case_sql(_RESP_PORTS, 'event_type')} AS id_resp_p,
  CASE event_id % 4 WHEN 0 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'tcp' END AS proto,
  CASE WHEN event_type = 'view' THEN 'http' ELSE '-' END AS service,
  value AS duration, CAST(floor(value * CAST(100 AS DOUBLE)) AS BIGINT) AS orig_bytes,
  CAST(k * 10 AS BIGINT) AS resp_bytes, CAST(k % 10 AS BIGINT) AS orig_pkts,
  event_id % 7 AS resp_pkts, CASE WHEN event_id % 7 = 0 THEN 'S0' ELSE 'SF' END AS conn_state,
  {pick_sql(_HISTORIES, 'event_id')} AS history,
  CASE WHEN event_id % 2 = 0 THEN CAST(floor(value * CAST(100 AS DOUBLE)) AS BIGINT) + 20 END AS orig_ip_bytes,
  CASE WHEN event_id % 3 = 0 THEN CAST(k * 10 + 40 AS BIGINT) END AS resp_ip_bytes,
  {case_sql(_LABELS, 'event_type')} AS label, k / CAST(100 AS DOUBLE) AS model_score, k FROM ev)""",
    "alerts": f"""alerts0 AS (SELECT *, {case_sql(S.LABEL_ATTACK_TYPES, 'label', "'DOS'")} AS attack_type FROM conn),
alerts AS (SELECT md5(uid) AS id, ts AS timestamp, ts + to_milliseconds(k) AS ingested_at,
  {SEVERITY_SQL.format(score='model_score', attack='attack_type')} AS severity,
  attack_type, id_orig_h AS src_ip, id_orig_p AS src_port, id_resp_h AS dst_ip, id_resp_p AS dst_port,
  upper(proto) AS protocol, 'ZEEK-' || uid AS rule_id, 'Zeek ' || attack_type AS rule_name, model_score,
  CASE WHEN label <> 'BENIGN' AND model_score >= 0.5 THEN 'malicious' ELSE 'benign' END AS model_label,
  {pick_sql(_SOURCES, 'event_id')} AS dataset_source,
  CASE WHEN event_id % 4 <> 0 THEN label END AS dataset_label, k, event_id FROM alerts0)""",
    "cic": f"""cic AS (SELECT {FLOW_ID_SQL} AS flow_id, label AS "Label", CAST(ts AS DATE) AS day
  FROM conn, range(CASE WHEN duration >= 50 THEN 2 ELSE 1 END) WHERE duration >= 5)""",
    "packets": """packets AS (SELECT CAST(l_orderkey AS VARCHAR) AS uid, l_shipdate AS ts,
  l_linenumber % 2 = 1 AS is_orig, CASE WHEN l_returnflag = 'R' THEN 'PA' ELSE 'A' END AS flags,
  CAST(floor(l_quantity) AS BIGINT) AS len FROM lineitem)""",
    "scored": """scored0 AS (SELECT event_id, k, CAST(event_id % 6 AS INTEGER) AS y_true FROM ev),
scored AS (SELECT event_id, k, y_true,
  CASE WHEN k < 80 THEN y_true ELSE CAST((y_true + 1) % 6 AS INTEGER) END AS y_pred FROM scored0),
probs AS (SELECT event_id, k, y_true, y_pred, CAST(c AS INTEGER) AS cls,
  CASE WHEN c = y_pred THEN CAST(0.5 AS DOUBLE) + k / CAST(400 AS DOUBLE)
       ELSE (CAST(0.5 AS DOUBLE) - k / CAST(400 AS DOUBLE)) / CAST(5 AS DOUBLE) END AS score
  FROM scored, range(6) AS r(c))""",
    "dirty": f"""dirty AS (SELECT event_id, k, ts, value, {_NUM_SQL} AS num_text, {_TIME_SQL} AS ts_text,
  {pick_sql(PROTO_TEXTS, 'event_id')} AS proto_text, {pick_sql(LABEL_TEXTS, 'event_id')} AS label_text,
  {pick_sql(KDD_TEXTS, 'event_id')} AS kdd_text, {pick_sql(ATTACK_TEXTS, 'event_id')} AS attack_text FROM ev)""",
}
_NEEDS = {"ev": [], "conn": ["ev"], "alerts": ["ev", "conn"], "cic": ["ev", "conn"],
          "packets": [], "scored": ["ev"], "dirty": ["ev"]}


def with_views(views: str, body: str) -> str:
    """SQL text with the named views (space separated) in front."""
    order: list[str] = []
    for name in views.split():
        for needed in [*_NEEDS[name], name]:
            if needed not in order:
                order.append(needed)
    if not order:
        return body
    parts = ",\n".join(VIEW_SQL[n] for n in order)
    text = body.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {parts},\n{text[5:]}"
    return f"WITH {parts}\n{text}"
