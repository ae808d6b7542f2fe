"""Ids, names, word lists, patterns and texts.

Everything here is data that a result must contain, or be matched against,
literally. Rules are ordered: the first one wins any of whose words, separated by
``|``, is found in the event name.
"""

# --- event mapping (fixed values) -------------------------------------------

CLASS_UID_RULES = [
    ("ssh_login_success|ssh_login_failure", 3002),
    ("web_login_success|web_login_failure", 3002),
    ("brute_force_attack", 2004),
    ("sql_injection_attempt", 2004),
    ("malware_detection", 2001),
    ("data_exfiltration", 4002),
    ("file_access", 1001),
]
CLASS_UID_DEFAULT = 2004

LOGIN_EVENTS = ["ssh_login_success", "ssh_login_failure", "web_login_success", "web_login_failure"]
LOGIN_TYPE_UID_SUCCESS = 300201
LOGIN_TYPE_UID_FAILURE = 300202
TYPE_UID_RULES = [
    ("brute_force_attack", 200402),
    ("sql_injection_attempt", 200402),
    ("malware_detection", 200101),
    ("data_exfiltration", 400202),
    ("file_access", 100101),
]
TYPE_UID_DEFAULT = 200402

ACTIVITY_RULES = [("success", 1), ("failure|attack|injection|malware|exfiltration", 2)]
ACTIVITY_DEFAULT = 99
ACTIVITY_NAMES = {1: "Allow", 2: "Deny"}
ACTIVITY_NAME_DEFAULT = "Unknown"

SEVERITY_RULES = [
    ("success", 1),
    ("failure", 2),
    ("brute_force|injection", 3),
    ("malware|exfiltration", 4),
]
SEVERITY_DEFAULT = 2

CATEGORY_RULES = [("login", 3), ("file", 1), ("attack|injection|malware|exfiltration", 2)]
CATEGORY_DEFAULT = 4
CATEGORY_NAMES = {
    1: "System Activity",
    2: "Findings",
    3: "Identity & Access Management",
    4: "Network Activity",
}

CLASS_NAME_RULES = [
    ("ssh_login|web_login", "Authentication"),
    ("brute_force|sql_injection|malware|data_exfiltration", "Security Finding"),
    ("file_access", "File System Activity"),
]
CLASS_NAME_DEFAULT = "Security Finding"

TYPE_NAME_RULES = [
    ("ssh_login", "SSH Authentication"),
    ("web_login", "Web Authentication"),
    ("brute_force", "Brute Force Attack"),
    ("sql_injection", "SQL Injection"),
    ("malware", "Malware Detection"),
    ("data_exfiltration", "Data Exfiltration"),
    ("file_access", "File Access"),
]
TYPE_NAME_DEFAULT = "Security Event"

LOG_LINE_PATTERN = (
    r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+) event=(\S+) user=(\S+) "
    r"src_ip=(\S+) dst_ip=(\S+).*$"
)

PRODUCT_NAME = "Traffic Simulator"
PRODUCT_VENDOR = "Custom"
PRODUCT_VERSION = "1.0"
PRODUCT_UID = "traffic-simulator-001"
METADATA_VERSION = "1.0.0"
METADATA_PROFILES = ["security_control"]

# --- stored event classes (fixed values) --------------------------------------

STORED_CLASSES = {
    1001: "File System Activity",
    2003: "Compliance Finding",
    2004: "Detection Finding",
    3002: "Authentication",
}

# --- sensor log types (fixed values) ------------------------------------------

SENSOR_LOG_TYPES = [
    "analyzer", "conn", "http", "dns", "ssl", "weird", "ftp", "known_hosts", "known_services",
]

# --- ports (fixed values) -----------------------------------------------------

EVENT_PORTS = {
    "ssh_login_success": 22,
    "ssh_login_failure": 22,
    "web_login_success": 80,
    "web_login_failure": 80,
    "file_access": 445,
    "brute_force_attack": 22,
    "sql_injection_attempt": 80,
    "malware_detection": 443,
    "data_exfiltration": 443,
    "rdp_login_success": 3389,
    "rdp_login_failure": 3389,
    "rdp_brute_force": 3389,
    "rdp_reconnaissance": 3389,
    "rdp_session_hijack": 3389,
}
DEFAULT_PORT = 22
PORT_SERVICES = {22: "SSH", 3389: "RDP", 80: "HTTP", 443: "HTTPS", 445: "SMB"}

# --- event sets of the reports (fixed values) -----------------------------------

THREAT_EVENTS = [
    "ssh_login_failure", "rdp_login_failure", "brute_force_attack", "rdp_brute_force",
    "sql_injection_attempt", "malware_detection", "data_exfiltration", "rdp_reconnaissance",
]
BRUTE_FORCE_EVENTS = [
    "brute_force_attack", "rdp_brute_force", "ssh_login_failure", "rdp_login_failure",
]
SERVICE_EVENTS = [
    "ssh_login_failure", "rdp_login_failure", "brute_force_attack", "rdp_brute_force",
    "sql_injection_attempt", "file_access",
]
ORIGIN_EVENTS = [
    "ssh_login_failure", "rdp_login_failure", "brute_force_attack", "rdp_brute_force",
    "sql_injection_attempt", "malware_detection",
]
TIMELINE_EVENTS = [
    "ssh_login_failure", "rdp_login_failure", "brute_force_attack", "rdp_brute_force",
    "ssh_login_success", "rdp_login_success",
]
BLOCKED_ATTACKS = ["brute_force_attack", "rdp_brute_force", "sql_injection_attempt"]
CRITICAL_EVENTS = ["malware_detection", "data_exfiltration"]
HIGH_EVENTS = ["rdp_brute_force", "brute_force_attack"]
MEDIUM_EVENTS = ["sql_injection_attempt", "rdp_reconnaissance"]

# --- detection rules (fixed values) ---------------------------------------------

INJECTION_PATTERN = (
    r"(?i)union.*select|drop.*table|insert.*into|select.*from|delete.*from|update.*set|exec|"
    r"script|javascript|vbscript|onload|onerror|eval\(|system\(|cmd"
)
INJECTION_NOTE = "HTTP::SQL_Injection_Attacker"
INJECTION_MESSAGE = "Potential SQL injection or code injection: "
DNS_PATTERN = r"\.(evil|bad|malware|botnet|phishing)\."
DNS_NOTE = "DNS::External_Name"
DNS_MESSAGE = "Suspicious DNS query: "
PASSWORD_GUESS_LIMIT = 3
PACKET_MESSAGE_EVERY = 100
CONNECTION_MESSAGE_EVERY = 10

INDICATOR_PHRASES = {
    "credential attacks": ["brute force", "password attack"],
    "lateral movement": ["lateral movement"],
    "privilege escalation": ["privilege escalation"],
    "data exfiltration": ["data exfiltration"],
}
TECHNIQUE_PHRASES = {
    "SSH exploitation": ["ssh"],
    "RDP attacks": ["rdp"],
    "PowerShell abuse": ["powershell"],
}
SYSTEM_PHRASES = {
    "Windows systems": ["windows"],
    "Linux systems": ["linux"],
    "Server infrastructure": ["server"],
}

# --- texts of the pattern report (fixed values) -----------------------------------

NO_HISTORY_SUMMARY = "No historical incidents found for analysis"
NO_HISTORY_ACTION = "Treat as novel threat - implement enhanced monitoring"
NO_HISTORY_TIMELINE = "No historical timeline available"
MIXED_SUMMARY = "Mixed attack patterns identified in historical incidents"
PATTERN_SUMMARY = "Historical incidents show pattern of %s with %d similar cases"
VECTORS_CORRELATION = "Multiple attack vectors observed: "
PLATFORM_CORRELATION = "Cross-platform targeting: "
LATERAL_PROGRESSION = "Typical progression: Initial access → Credential harvesting → Lateral movement"
ESCALATION_PROGRESSION = "Attackers typically attempt privilege escalation after initial compromise"
CREDENTIAL_ACTION = "Implement multi-factor authentication and account lockout policies"
LATERAL_ACTION = "Deploy network segmentation and lateral movement detection"
ESCALATION_ACTION = "Review and restrict administrative privileges"
FALLBACK_ACTION = "Monitor for indicators identified in similar historical incidents"
TIMELINE_TEXT = "Based on %d historical incidents spanning multiple timeframes"
HIGH_CONFIDENCE_BELOW = 0.3
MEDIUM_CONFIDENCE_BELOW = 0.7

MAX_RESULTS_PER_SEARCH = 2
MAX_DOCUMENTS = 5

DOCUMENT_SOURCE = "vector_database"
DOCUMENT_CATEGORY = "security_incident"
DOCUMENT_NO_INFO = "No additional metadata available"
DOCUMENT_QUERY_INFO = "Retrieved via query: "

# --- class catalogue (fixed values) -------------------------------------------------

CLASS_CATALOGUE = {
    "System Activity": {
        1001: "File System Activity", 1002: "Kernel Extension Activity", 1003: "Kernel Activity",
        1004: "Memory Activity", 1005: "Module Activity", 1006: "Scheduled Job Activity",
        1007: "Process Activity",
    },
    "Identity & Access Management": {
        3001: "Account Change", 3002: "Authentication", 3003: "Authorize Session",
        3004: "Entity Management", 3005: "User Access Management", 3006: "Group Management",
    },
    "Network Activity": {
        4001: "Network Activity", 4002: "HTTP Activity", 4003: "DNS Activity",
        4004: "DHCP Activity", 4005: "RDP Activity", 4006: "SMB Activity", 4007: "SSH Activity",
        4008: "FTP Activity", 4009: "Email Activity", 4010: "Network File Activity",
        4011: "Email File Activity", 4012: "Email URL Activity",
    },
    "Findings": {
        2001: "Security Finding", 2002: "Vulnerability Finding", 2003: "Compliance Finding",
        2004: "Detection Finding", 2005: "Incident Finding",
    },
    "Discovery": {5001: "Device Inventory Info", 5002: "Device Config State"},
    "Application Activity": {
        6001: "Web Resource Activity", 6002: "Application Lifecycle", 6003: "API Activity",
        6004: "Web Resource Access Activity",
    },
}

# --- enum captions (fixed values) -----------------------------------------------------

ENUM_CAPTIONS = {
    "severity_id": {
        0: "Unknown", 1: "Informational", 2: "Low", 3: "Medium", 4: "High", 5: "Critical",
        6: "Fatal", 99: "Other",
    },
    "status_id": {
        0: "Unknown", 1: "New", 2: "InProgress", 3: "Suppressed", 4: "Resolved", 5: "Archived",
        99: "Other",
    },
    "finding_activity_id": {0: "Unknown", 1: "Create", 2: "Update", 3: "Close", 99: "Other"},
    "auth_activity_id": {
        0: "Unknown", 1: "Logon", 2: "Logoff", 3: "AuthenticationTicket",
        4: "ServiceTicketRequest", 5: "ServiceTicketRenew", 6: "Preauth", 99: "Other",
    },
    "confidence_id": {0: "Unknown", 1: "Low", 2: "Medium", 3: "High", 99: "Other"},
    "impact_id": {0: "Unknown", 1: "Low", 2: "Medium", 3: "Hig", 4: "Critical", 99: "Other"},
    "risk_level_id": {0: "Info", 1: "Low", 2: "Medium", 3: "High", 4: "Critical"},
    "disposition_id": {
        0: "Unknown", 1: "Allowed", 2: "Blocked", 3: "Quarantined", 4: "Isolated", 5: "Deleted",
        6: "Dropped", 7: "CustomAction", 8: "Approved", 9: "Restored", 10: "Exonerated",
        11: "Corrected", 12: "PartiallyCorrected", 13: "Uncorrected", 14: "Delayed",
        15: "Detected", 16: "NoAction", 17: "Logged", 18: "Tagged", 19: "Alert", 20: "Count",
        21: "Reset", 22: "CaptchaRequired", 23: "ChallengeRan", 24: "AccessRevoked",
        25: "Rejected", 26: "Unauthorized", 27: "Error", 99: "Other",
    },
    "auth_protocol_id": {
        0: "Unknown", 1: "NTLM", 2: "Kerberos", 3: "Digest", 4: "OpenID", 5: "SAML", 6: "OAuth2",
        7: "PAP", 8: "CHAP", 9: "EAP", 10: "RADIUS", 11: "BasicAuthentication", 12: "LDAP",
        99: "Other",
    },
    "logon_type_id": {
        0: "Unknown", 1: "System", 2: "Interactive", 3: "Network", 4: "Batch", 5: "OSService",
        7: "Unlock", 8: "NetworkCleartext", 9: "NewCredentials", 10: "RemoteInteractive",
        11: "CachedInteractive", 12: "CachedRemoteInteractive", 13: "CachedUnlock", 99: "Other",
    },
    "auth_type_uid": {
        300200: "Unknown", 300201: "Logon", 300202: "Logoff", 300203: "AuthenticationTicket",
        300204: "ServiceTicketRequest", 300205: "ServiceTicketRenew", 300206: "Preauth",
        300299: "Other",
    },
    "detection_type_uid": {
        200400: "Unknown", 200401: "Create", 200402: "Update", 200403: "Close", 200499: "Other",
    },
    "compliance_type_uid": {
        200300: "Unknown", 200301: "Create", 200302: "Update", 200303: "Close", 200399: "Other",
    },
}

# Ids that a child of an object may have (fixed values).
OBJECT_ENUMS = {
    "account_type_id": [*range(0, 11), 99],
    "device_type_id": [*range(0, 12), 99],
    "observable_type_id": [*range(0, 11), *range(20, 31), 99],
    "risk_level_id": [*range(0, 5)],
}
