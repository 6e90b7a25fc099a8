"""Types, enumerations and lookup tables.

Everything here is a fixed value of the data model (wire names, label spellings,
port numbers, texts); nothing is computed.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: enumerations ------------------------------------------------

SEVERITIES = ["Low", "Medium", "High", "Critical"]
ATTACK_TYPES = ["BENIGN", "BOT", "BRUTE_FORCE", "DDOS", "DOS", "PORTSCAN"]
PROTOCOLS = ["TCP", "UDP", "ICMP", "HTTP", "HTTPS", "DNS", "Other"]

# Model output position -> class name.
CLASS_NAMES = ["BENIGN", "BOT", "BRUTE_FORCE", "DDOS", "DOS", "PORTSCAN"]

# --- fixed values: protocols and services --------------------------------------

PROTOCOL_NUMBERS = {"icmp": 1, "tcp": 6, "udp": 17}

SERVICE_BY_PORT = {
    20: "ftp", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns",
    67: "dhcp", 68: "dhcp", 80: "http", 110: "pop3", 123: "ntp", 135: "msrpc",
    137: "netbios", 139: "netbios", 143: "imap", 389: "ldap", 443: "https",
    445: "smb", 465: "smtp", 587: "smtp", 993: "imap", 995: "pop3",
    1433: "mssql", 1521: "oracle", 2049: "nfs", 3306: "mysql", 3389: "rdp",
    5060: "sip", 5432: "postgres", 5900: "vnc", 5985: "wsman",
    8080: "http-alt", 8443: "https",
}

SERVING_HTTP_PORTS = [80, 443, 8000, 8080]
TRAINING_HTTP_PORTS = [80, 443, 8080]
HTTP_SERVICES = ["http", "http-alt", "https"]
SSH_PORT = 22

# --- fixed values: label tables ------------------------------------------------

# Upper-cased flow label -> display class.
LABEL_CLASSES = {
    "BENIGN": "BENIGN",
    "BOT": "Bot",
    "BRUTE FORCE": "Brute Force",
    "DDOS": "DDoS",
    "DOS GOLDENEYE": "DoS",
    "DOS HULK": "DoS",
    "DOS SLOWHTTP": "DoS",
    "DOS SLOWHTTPTEST": "DoS",
    "DOS SLOWLORIS": "DoS",
    "FTP-PATATOR": "Brute Force",
    "HEARTBLEED": "Heartbleed",
    "INFILTRATION": "Infiltration",
    "PORT SCAN": "Port Scan",
    "PORTSCAN": "Port Scan",
    "SCANNING": "Port Scan",
    "SSH-PATATOR": "Brute Force",
    "WEB ATTACK - BRUTE FORCE": "Web Attack",
    "WEB ATTACK - SQL INJECTION": "Web Attack",
    "WEB ATTACK - XSS": "Web Attack",
    "WEB ATTACK BRUTE FORCE": "Web Attack",
    "WEB ATTACK SQL INJECTION": "Web Attack",
    "WEB ATTACK XSS": "Web Attack",
}

# Raw flow label -> grouped attack (web attacks are spelled with three dashes).
CIC_ATTACK_GROUPS = {
    "BENIGN": "BENIGN",
    "Bot": "Bot",
    "DDoS": "DDoS",
    "DoS GoldenEye": "DoS",
    "DoS Hulk": "DoS",
    "DoS Slowhttptest": "DoS",
    "DoS slowloris": "DoS",
    "FTP-Patator": "Brute Force",
    "Heartbleed": "Heartbleed",
    "Infiltration": "Infiltration",
    "PortScan": "Port Scan",
    "SSH-Patator": "Brute Force",
    "Web Attack - Brute Force": "Web Attack",
    "Web Attack - Sql Injection": "Web Attack",
    "Web Attack - XSS": "Web Attack",
    "Web Attack – Brute Force": "Web Attack",
    "Web Attack – Sql Injection": "Web Attack",
    "Web Attack – XSS": "Web Attack",
    "Web Attack � Brute Force": "Web Attack",
    "Web Attack � Sql Injection": "Web Attack",
    "Web Attack � XSS": "Web Attack",
}

# Hyphenated web-attack spellings -> the en-dash spelling used by the dataset.
CIC_DASH_SPELLINGS = {
    "Web Attack - Brute Force": "Web Attack – Brute Force",
    "Web Attack - Sql Injection": "Web Attack – Sql Injection",
    "Web Attack - XSS": "Web Attack – XSS",
}

# Raw flow label -> alert attack type.
LABEL_ATTACK_TYPES = {
    "BENIGN": "BENIGN",
    "Bot": "BOT",
    "DDoS": "DDOS",
    "DoS GoldenEye": "DOS",
    "DoS Hulk": "DOS",
    "DoS Slowhttptest": "DOS",
    "DoS slowloris": "DOS",
    "FTP-Patator": "BRUTE_FORCE",
    "Heartbleed": "DOS",
    "Infiltration": "DOS",
    "PortScan": "PORTSCAN",
    "SSH-Patator": "BRUTE_FORCE",
    "Web Attack – Brute Force": "BRUTE_FORCE",
    "Web Attack – Sql Injection": "DOS",
    "Web Attack – XSS": "DOS",
}

# KDD superclass -> labels.
# Class order of the KDD task, and the class of each label.
KDD_CLASSES = ["DoS", "Normal", "Probe", "R2L", "U2R"]
KDD_CLASS_OF = {
    "apache2": "DoS", "back": "DoS", "land": "DoS", "mailbomb": "DoS", "neptune": "DoS", "pod": "DoS",
    "processtable": "DoS", "smurf": "DoS", "teardrop": "DoS", "udpstorm": "DoS",
    "normal": "Normal",
    "ipsweep": "Probe", "mscan": "Probe", "nmap": "Probe", "portsweep": "Probe", "saint": "Probe",
    "satan": "Probe",
    "ftp_write": "R2L", "guess_passwd": "R2L", "http_tunnel": "R2L", "imap": "R2L", "multihop": "R2L",
    "named": "R2L", "phf": "R2L", "sendmail": "R2L", "snmpgetattack": "R2L", "snmpguess": "R2L", "spy": "R2L",
    "warezclient": "R2L", "warezmaster": "R2L",
    "buffer_overflow": "U2R", "loadmodule": "U2R", "perl": "U2R", "ps": "U2R", "rootkit": "U2R",
    "sqlattack": "U2R", "xterm": "U2R",
}

KDD_FEATURES = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land",
    "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in",
    "num_compromised", "root_shell", "su_attempted", "num_root", "num_file_creations",
    "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login",
    "is_guest_login", "count", "srv_count", "serror_rate", "srv_serror_rate",
    "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate",
    "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count",
    "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
    "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate",
    "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
]

# --- fixed values: severity ----------------------------------------------------

SEVERITY_RANK = {"Low": 0, "Medium": 1, "High": 2, "Critical": 3}
SEVERITY_POLICY = {
    "BENIGN": "Low", "BOT": "Critical", "BRUTE_FORCE": "High",
    "DDOS": "Critical", "DOS": "Medium", "PORTSCAN": "Medium",
}
SEVERITY_FLOOR = dict(SEVERITY_POLICY)
HIGH_BY_TYPE = ["BOT", "BRUTE_FORCE", "DDOS", "DOS"]

# --- fixed values: texts -------------------------------------------------------

ATTACK_TEXT = {
    "BENIGN": "Benigno", "BOT": "Bot", "BRUTE_FORCE": "Fuerza bruta",
    "DDOS": "DDoS", "DOS": "DoS", "PORTSCAN": "Escaneo de puertos",
}
SEVERITY_TEXT = {"Low": "Baja", "Medium": "Media", "High": "Alta", "Critical": "Crítica"}
CONFIDENCE_TEXT = {"benign": "Confianza en benigno", "malicious": "Probabilidad de ataque"}
INCIDENT_TITLES = {
    "BOT": "Malware detectado",
    "BRUTE_FORCE": "Ataque de fuerza bruta",
    "DDOS": "Ataque DDoS detectado",
    "DOS": "Ataque de denegación detectado",
    "PORTSCAN": "Escaneo de puertos detectado",
}
ATTACK_SUMMARY = {
    "BENIGN": "Tráfico clasificado como benigno por el modelo actual.",
    "BOT": "Actividad compatible con malware tipo bot se detectó comunicándose con C2.",
    "BRUTE_FORCE": "Intentos masivos de autenticación fueron detectados contra servicios críticos.",
    "DDOS": "Se detectó un pico de tráfico distribuido dirigido al servicio público.",
    "DOS": "Se observó un patrón de solicitudes repetitivas que impactan la disponibilidad.",
    "PORTSCAN": "El origen está enumerando puertos abiertos en los segmentos protegidos.",
}
ATTACK_PLAYBOOKS = {
    "BOT": [
        "Desconectar el host comprometido y ejecutar análisis antimalware.",
        "Revocar credenciales utilizadas desde el activo identificado.",
        "Supervisar tráfico de salida hacia dominios C2 conocidos.",
    ],
    "BRUTE_FORCE": [
        "Habilitar MFA en las cuentas objetivo si aún no está activo.",
        "Bloquear temporalmente la IP origen.",
        "Obligar cambio de contraseñas afectadas y auditar accesos.",
    ],
    "DDOS": [
        "Habilitar mitigación DDoS en el borde y ajustar políticas de rate limiting.",
        "Coordinar con el ISP para filtrar tráfico proveniente del origen sospechoso.",
        "Monitorizar métricas de disponibilidad del servicio afectado cada 5 minutos.",
    ],
    "DOS": [
        "Implementar filtros temporales para el origen identificado.",
        "Validar la salud del servicio y reiniciarlo si es necesario.",
        "Escalar al equipo de redes si el patrón persiste.",
    ],
    "PORTSCAN": [
        "Bloquear la IP fuente en el firewall perimetral.",
        "Revisar registros de IPS en busca de explotación posterior.",
        "Notificar al SOC para seguimiento del origen.",
    ],
}
FALLBACK_PLAYBOOKS = {
    "BENIGN": [
        "Registrar el evento para entrenamiento futuro.",
        "Verificar falsos positivos.",
        "No se requiere acción inmediata.",
    ],
    "BOT": [
        "Aislar el host infectado y ejecutar análisis DFIR.",
        "Revocar credenciales utilizadas desde el dispositivo.",
        "Monitorear tráfico hacia dominios C2 relacionados.",
    ],
    "BRUTE_FORCE": [
        "Habilitar MFA en los servicios atacados.",
        "Bloquear la IP origen y rotar credenciales afectadas.",
        "Revisar registros de autenticación fallida.",
    ],
    "DDOS": [
        "Activar mitigación DDoS en el borde o proveedor.",
        "Coordinar con el ISP para filtrar prefijos maliciosos.",
        "Monitorizar métricas de disponibilidad cada 5 minutos.",
    ],
    "DOS": [
        "Aplicar rate-limiting en el servicio impactado.",
        "Bloquear temporalmente la IP de origen en el firewall.",
        "Notificar al equipo de redes si la saturación continúa.",
    ],
    "PORTSCAN": [
        "Bloquear la IP ofensora en el firewall perimetral.",
        "Auditar servicios expuestos en el segmento escaneado.",
        "Revisar logs para intentos subsecuentes.",
    ],
}
DATASET_TEXT = {
    "reference": "Dataset de referencia",
    "default": "Dataset sincronizado",
    "uploaded": "Dataset personalizado",
}

# --- fixed values: column sets -------------------------------------------------

CONN_FEATURES = [
    "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts",
    "bytes_total", "bytes_ratio", "pkts_total", "pkts_ratio",
    "proto_tcp", "proto_udp", "proto_icmp", "is_http", "is_ssh",
]

# Flow features in ranking order (names as in the flow dataset).
CIC_FEATURES = [
    "Bwd Packet Length Max", "Avg Fwd Segment Size", "Fwd Packet Length Mean",
    "Bwd Packet Length Min", "PSH Flag Count", "Subflow Fwd Packets",
    "Total Length of Bwd Packets", "Total Fwd Packets", "act_data_pkt_fwd",
    "Fwd Packet Length Min", "Idle Min", "Bwd Packets/s", "Destination Port",
    "min_seg_size_forward", "Init_Win_bytes_backward", "Bwd Packet Length Std",
    "Avg Bwd Segment Size", "Packet Length Mean", "Min Packet Length",
    "Bwd Packet Length Mean", "Fwd Packet Length Std", "Bwd Header Length",
    "Subflow Fwd Bytes", "FIN Flag Count", "Subflow Bwd Bytes", "Bwd IAT Max",
    "Fwd Packet Length Max", "Active Std", "Fwd Header Length", "Active Max",
    "Bwd IAT Min", "Fwd IAT Std", "Average Packet Size",
    "Total Length of Fwd Packets", "Packet Length Std", "Flow Packets/s",
    "Init_Win_bytes_forward", "Idle Std", "Flow IAT Max", "Fwd PSH Flags",
    "Bwd IAT Std", "Down/Up Ratio", "Idle Mean", "Fwd IAT Min", "Flow IAT Mean",
    "SYN Flag Count", "Max Packet Length", "URG Flag Count", "Bwd IAT Total",
    "Flow Duration", "Fwd Header Length.1", "Flow IAT Std", "Fwd IAT Max",
    "ACK Flag Count", "Packet Length Variance", "Idle Max", "Bwd IAT Mean",
    "Flow IAT Min", "Fwd IAT Mean", "Flow Bytes/s", "Total Backward Packets",
    "Fwd Packets/s", "Subflow Bwd Packets", "Active Min", "Active Mean",
    "Fwd IAT Total", "Fwd URG Flags", "ECE Flag Count", "RST Flag Count",
    "CWE Flag Count", "Bwd PSH Flags", "Fwd Avg Bulk Rate", "Fwd Avg Bytes/Bulk",
    "Fwd Avg Packets/Bulk", "Bwd URG Flags", "Bwd Avg Bytes/Bulk",
    "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate",
]

# Flow feature -> packet-log columns to take it from, first present wins.
PACKET_LOG_SOURCES = {
    "Bwd Packet Length Max": ["bwd_pkt_len_max"],
    "Avg Fwd Segment Size": ["avg_fwd_seg_size"],
    "Fwd Packet Length Mean": ["fwd_pkt_len_mean"],
    "Bwd Packet Length Min": ["bwd_pkt_len_min"],
    "PSH Flag Count": ["psh_flag_count"],
    "Subflow Fwd Packets": ["subflow_fwd_pkts", "total_fwd_pkts"],
    "Total Length of Bwd Packets": ["total_bwd_len"],
    "Total Fwd Packets": ["total_fwd_pkts"],
    "act_data_pkt_fwd": ["act_data_pkt_fwd"],
    "Fwd Packet Length Min": ["fwd_pkt_len_min"],
    "Idle Min": ["idle_min"],
    "Bwd Packets/s": ["bwd_pkts_per_sec"],
    "Destination Port": ["id_resp_p", "dst_port"],
    "min_seg_size_forward": ["min_seg_size_forward", "avg_fwd_seg_size"],
    "Init_Win_bytes_backward": ["init_win_bytes_bwd"],
    "Bwd Packet Length Std": ["bwd_pkt_len_std"],
    "Avg Bwd Segment Size": ["avg_bwd_seg_size"],
    "Packet Length Mean": ["pkt_len_mean"],
    "Min Packet Length": ["min_pkt_len"],
    "Bwd Packet Length Mean": ["bwd_pkt_len_mean"],
}

# Logical flow column -> accepted header spellings, first non-blank wins.
FLOW_COLUMNS = {
    "timestamp": ["Timestamp", "timestamp", "Flow Timestamp"],
    "src_ip": ["Source IP", "Src IP", "src_ip"],
    "src_port": ["Source Port", "Src Port", "src_port"],
    "dst_ip": ["Destination IP", "Dst IP", "DestinationIP", "dst_ip"],
    "dst_port": ["Destination Port", "Dst Port", "Destination Port Number", "dst_port"],
    "protocol": ["Protocol", "Protocol Name", "protocol"],
    "flow_duration": ["Flow Duration", "Flow_Duration"],
    "orig_pkts": ["Total Fwd Packets", "Tot Fwd Pkts", "Fwd Packet Count"],
    "resp_pkts": ["Total Backward Packets", "Tot Bwd Pkts", "Bwd Packet Count"],
    "orig_bytes": ["Total Length of Fwd Packets", "TotLen Fwd Pkts", "Fwd Packet Length Total"],
    "resp_bytes": ["Total Length of Bwd Packets", "TotLen Bwd Pkts", "Bwd Packet Length Total"],
    "label": ["Label", "Attack", "Attack Label"],
    "flow_id": ["Flow ID", "FlowID"],
}
ESSENTIAL_FLOW_COLUMNS = ["timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "protocol"]

# Conn log columns in file order; dots are written as in the log format.
CONN_COLUMNS = [
    "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service",
    "duration", "orig_bytes", "resp_bytes", "conn_state", "local_orig", "local_resp",
    "missed_bytes", "history", "orig_pkts", "orig_ip_bytes", "resp_pkts",
    "resp_ip_bytes", "tunnel_parents", "ip_proto", "cicids_label", "cicids_attack",
    "flow_id", "source_file", "dataset_name",
]
CONN_REQUIRED = CONN_COLUMNS[:12]
CONN_NUMERIC = [
    "id.orig_p", "id.resp_p", "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts",
]

FEATURE_FILE_META = [
    "Flow ID", "Source IP", "Source Port", "Destination IP", "Destination Port",
    "Protocol", "Timestamp",
]
ORIGINAL_LABEL_COLUMNS = ["Label", "Attack", "cicids_attack", "cicids_label"]

ALERT_READY_COLUMNS = [
    "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service",
    "conn_state", *CONN_FEATURES, "Label",
]

ALERT_EXPORT_COLUMNS = [
    "id", "timestamp", "severity", "attack_type", "src_ip", "src_port", "dst_ip",
    "dst_port", "protocol", "rule_id", "rule_name", "model_score", "model_label",
]

# Day files of the flow dataset in reading order.
CIC_DAY_FILES = [
    "Monday-WorkingHours.pcap_ISCX.csv",
    "Tuesday-WorkingHours.pcap_ISCX.csv",
    "Wednesday-workingHours.pcap_ISCX.csv",
    "Thursday-WorkingHours-Morning-WebAttacks.pcap_ISCX.csv",
    "Thursday-WorkingHours-Afternoon-Infilteration.pcap_ISCX.csv",
    "Friday-WorkingHours-Morning.pcap_ISCX.csv",
    "Friday-WorkingHours-Afternoon-PortScan.pcap_ISCX.csv",
    "Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv",
]

# Class caps and oversampling bounds of the training recipes.
CLASS_CAPS = {"BENIGN": 80_000, "DOS": 70_000, "DDOS": 50_000, "PORTSCAN": 20_000}
SMOTE_THRESHOLD_TARGET = 15_000
SMOTE_THRESHOLD_MIN = 300
REPORT_RANGES = {"1h": 1, "24h": 24, "7d": 168, "30d": 720}

# --- schemas ------------------------------------------------------------------

ALERT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("ingested_at", T.TimestampType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("attack_type", T.StringType(), False),
    T.StructField("src_ip", T.StringType(), False),
    T.StructField("src_port", T.IntegerType(), False),
    T.StructField("dst_ip", T.StringType(), False),
    T.StructField("dst_port", T.IntegerType(), False),
    T.StructField("protocol", T.StringType(), False),
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("rule_name", T.StringType(), False),
    T.StructField("model_score", T.DoubleType(), False),
    T.StructField("model_label", T.StringType(), False),
    T.StructField("meta", T.StringType(), True),
])

PACKET_LOG_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("uid", T.StringType()),
        T.StructField("id_orig_h", T.StringType()),
        T.StructField("id_orig_p", T.IntegerType()),
        T.StructField("id_resp_h", T.StringType()),
        T.StructField("id_resp_p", T.IntegerType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("total_fwd_pkts", T.LongType()),
        T.StructField("total_bwd_pkts", T.LongType()),
        T.StructField("total_fwd_len", T.DoubleType()),
        T.StructField("total_bwd_len", T.DoubleType()),
        T.StructField("fwd_pkt_len_min", T.DoubleType()),
        T.StructField("fwd_pkt_len_mean", T.DoubleType()),
        T.StructField("bwd_pkt_len_min", T.DoubleType()),
        T.StructField("bwd_pkt_len_mean", T.DoubleType()),
        T.StructField("bwd_pkt_len_max", T.DoubleType()),
        T.StructField("bwd_pkt_len_std", T.DoubleType()),
        T.StructField("pkt_len_mean", T.DoubleType()),
        T.StructField("min_pkt_len", T.DoubleType()),
        T.StructField("avg_fwd_seg_size", T.DoubleType()),
        T.StructField("avg_bwd_seg_size", T.DoubleType()),
        T.StructField("bwd_pkts_per_sec", T.DoubleType()),
        T.StructField("psh_flag_count", T.LongType()),
        T.StructField("subflow_fwd_pkts", T.LongType()),
        T.StructField("act_data_pkt_fwd", T.LongType()),
        T.StructField("idle_min", T.DoubleType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("min_seg_size_forward", T.DoubleType()),
        T.StructField("init_win_bytes_bwd", T.DoubleType()),
    ]
)
