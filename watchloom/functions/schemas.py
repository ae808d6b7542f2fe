"""Declared schemas of stored tables (fixed values), in a short notation.

``name:type`` is optional, ``name:type!`` required. Types: ``str int float bool ts``
as stored columns; ``enum(x)`` an id out of ``values.ENUM_CAPTIONS[x]``; ``list`` any
array; ``any`` any value; a capitalised name an object, in brackets an array of
objects. Objects name the children that carry a rule: required ones, objects in turn,
and scalars whose type is checked. The value of an object is kept whole.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- sensor logs (fixed values) -------------------------------------------------------

_ID = "id_orig_h:str id_orig_p:int id_resp_h:str id_resp_p:int"

SENSOR_FIELDS = {
    "analyzer": f"ts:ts cause:str analyzer_kind:str analyzer_name:str uid:str fuid:str {_ID} "
    "failure_reason:str failure_data:str",
    "conn": f"ts:ts uid:str {_ID} proto:str service:str duration:float orig_bytes:int resp_bytes:int "
    "conn_state:str local_orig:bool local_resp:bool missed_bytes:int history:str orig_pkts:int "
    "orig_ip_bytes:int resp_pkts:int resp_ip_bytes:int ip_proto:int tunnel_parents:str vlan:int "
    "inner_vlan:int orig_l2_addr:str resp_l2_addr:str community_id:str orig_shim:str resp_shim:str",
    "http": f"ts:ts uid:str {_ID} trans_depth:int method:str host:str uri:str referrer:str version:str "
    "user_agent:str origin:str request_body_len:int response_body_len:int status_code:int "
    "status_msg:str info_code:int info_msg:str tags:list username:str password:str proxied:str "
    "orig_fuids:str orig_filenames:str orig_mime_types:str resp_fuids:str resp_filenames:str "
    "resp_mime_types:str",
    "dns": f"ts:ts uid:str {_ID} proto:str trans_id:int rtt:float query:str qclass:int qclass_name:str "
    "qtype:int qtype_name:str rcode:int rcode_name:str AA:bool TC:bool RD:bool RA:bool Z:int "
    "answers:str TTLs:str rejected:bool",
    "ssl": f"ts:ts uid:str {_ID} version:str cipher:str curve:str server_name:str resumed:bool "
    "last_alert:str next_protocol:str established:bool cert_chain_fuids:str "
    "client_cert_chain_fuids:str subject:str issuer:str client_subject:str client_issuer:str "
    "validation_status:str",
    "weird": f"ts:ts uid:str {_ID} name:str addl:str notice:bool peer:str",
    "ftp": f"ts:ts uid:str {_ID} user:str command:str arg:str",
    "known_hosts": "ts:ts host:str",
    "known_services": "ts:ts host:str port_num:int port_proto:str service:str",
}

# --- event classes (fixed values) -------------------------------------------------------

_BASE = (
    "enrichments:[Enrichment] message:str metadata:Metadata! observables:[Observable] raw_data:str "
    "severity_id:enum(severity_id)! severity:str status:str status_code:str status_detail:str "
    "unmapped:any"
)
_FINDING = (
    "activity_name:str activity_id:enum(finding_activity_id)! comment:str confidence:str "
    "confidence_id:enum(confidence_id) confidence_score:int end_time:int end_time_dt:ts "
    "finding_info:FindingInformation! start_time:int start_time_dt:ts status_id:enum(status_id)"
)

EVENT_FIELDS = {
    1001: f"{_BASE} activity_id:int! category_uid:int! class_uid:int! time:int! access_mask:int "
    "activity_name:str category_name:str class_name:str component:str connection_uid:str count:int "
    "create_mask:str device:Device duration:int end_time:int end_time_dt:ts file:File file_diff:str "
    "file_result:str raw_data_size:int start_time:int start_time_dt:ts status_id:enum(status_id) "
    "time_dt:ts timezone_offset:int type_name:str type_uid:int",
    2003: f"{_BASE} {_FINDING} category_name:str category_uid:int class_name:str class_uid:int "
    "compliance:Compliance! device:Device evidences:[Evidence] remediation:Remediation "
    "resources:[Resource] time:int! time_dt:ts timezone_offset:int "
    "type_uid:enum(compliance_type_uid)! type_name:str",
    2004: f"{_BASE} {_FINDING} resources:[Resource] category_name:str category_uid:int class_name:str "
    "class_uid:int cloud:Cloud api:Api count:int duration:int evidences:[Evidence] impact:str "
    "impact_score:int impact_id:enum(impact_id) remediation:Remediation risk_level:str "
    "risk_level_id:enum(risk_level_id) risk_score:int risk_details:str time:int! time_dt:ts "
    "timezone_offset:int type_uid:enum(detection_type_uid)! type_name:str "
    "vulnerabilities:[Vulnerability]",
    3002: f"{_BASE} activity_id:enum(auth_activity_id)! category_uid:int class_uid:int time:int! "
    "type_uid:enum(auth_type_uid)! activity_name:str actor:Actor auth_factors:[Factor] "
    "auth_protocol:str auth_protocol_id:enum(auth_protocol_id) authentication_token:Token "
    "category_name:str certificate:str class_name:str count:int dst_endpoint:Endpoint duration:int "
    "end_time:int end_time_dt:ts is_cleartext:bool is_mfa:bool is_new_logon:bool is_remote:bool "
    "logon_process:Process logon_type:str logon_type_id:enum(logon_type_id) service:Service "
    "session:Session src_endpoint:Endpoint start_time:int start_time_dt:ts "
    "status_id:enum(status_id) time_dt:ts timezone_offset:int type_name:str user:User",
}

# Values of fields that an event leaves out (fixed values).
EVENT_DEFAULTS = {
    1001: {},
    2003: {
        "category_name": "Findings", "category_uid": 2, "class_name": "ComplianceFinding",
        "class_uid": 2003,
    },
    2004: {
        "category_name": "Findings", "category_uid": 2, "class_name": "Detection Finding",
        "class_uid": 2004,
    },
    3002: {
        "category_name": "Identity & Access Management", "category_uid": 3,
        "class_name": "Authentication", "class_uid": 3002,
    },
}

# Rules inside objects (fixed values): required children, child objects, types of scalars.
OBJECT_RULES = {
    "Account": "name:str! type:str type_id:enum(account_type_id)! uid:str! labels:list",
    "Actor": "user:User",
    "Analytic": "category:str desc:str name:str! type:str type_id:int! uid:str! version:str",
    "Api": "operation! request:Request response:Response service:Service",
    "Cloud": "provider! account:Account",
    "Compliance": "",
    "Container": "name! uid! hash:Fingerprint image:Image",
    "Device": "hostname! ip! name! region! type_id:enum(device_type_id)! uid! image:Image "
    "network_interfaces:[Interface] os:System is_managed:bool risk_level_id:enum(risk_level_id)",
    "DnsQuery": "hostname!",
    "Endpoint": "ip:str port:int hostname:str domain:str mac:str subnet:str vlan:str",
    "Enrichment": "data! name! value!",
    "Evidence": "api:Api device:Device query:DnsQuery resources:[Resource]",
    "Extension": "name:str! uid:str! version:str!",
    "Factor": "",
    "File": "name! type_id!",
    "FindingInformation": "title:str! uid:str! analytic:Analytic kill_chain:[Phase] related_analytics:[Analytic] "
    "related_events:[RelatedEvent] attacks:[Attack] created_time:int created_time_dt:ts data_sources:list desc:str "
    "first_seen_time:int first_seen_time_dt:ts last_seen_time:int last_seen_time_dt:ts modified_time:int "
    "modified_time_dt:ts src_url:str types:list",
    "Fingerprint": "algorithm_id! value!",
    "Attack": "technique:Technique",
    "Image": "name! uid!",
    "Interface": "hostname! ip! mac! name! type_id!",
    "Article": "os:System! product:Product severity! title! uid!",
    "Logger": "log_name! log_provider! name! product:Product! uid! device:Device",
    "Metadata": "product:Product! loggers:[Logger] extensions:[Extension] correlation_uid:str event_code:str uid:str "
    "labels:list log_level:str log_name:str log_provider:str log_version:str logged_time:ts modified_time:ts "
    "original_time:str processed_time:ts profiles:list sequence:int tenant_uid:str version:str",
    "Observable": "name:str! type:str type_id:enum(observable_type_id)! value:str reputation:Reputation",
    "Phase": "phase! phase_id!",
    "Process": "",
    "Product": "vendor_name:str! lang:str name:str path:str cpe_name:str url_string:str uid:str version:str",
    "RelatedEvent": "uid:str! type:str type_uid:int attacks:[Attack] observables:[Observable]",
    "Remediation": "desc! kb_article_list:[Article]",
    "Reputation": "provider! base_score! score_id!",
    "Request": "uid! containers:[Container]",
    "Resource": "owner:User",
    "Response": "containers:[Container]",
    "Service": "name:str! uid:str! version:str! labels:list",
    "Session": "",
    "System": "name! type_id!",
    "Technique": "name:str! src_url:str uid:str!",
    "Token": "",
    "User": "name:str! uid:str! account:Account uid_alt:str domain:str email_addr:str groups:list type:str type_id:int "
    "credential_uid:str",
    "Vulnerability": "remediation:Remediation",
}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # str int float bool ts list any enum object objects
    detail: str = ""  # enum name or object name
    required: bool = False

    @property
    def sql_type(self) -> str:
        return {
            "str": "string", "int": "bigint", "float": "double", "bool": "boolean",
            "ts": "timestamp", "enum": "int",
        }.get(self.kind, "variant")


def parse_fields(text: str) -> list[Field]:
    fields = []
    for word in text.split():
        required = word.endswith("!")
        name, _, kind = word.rstrip("!").partition(":")
        kind, detail = kind or "any", ""
        if kind.startswith("enum("):
            kind, detail = "enum", kind[5:-1]
        elif kind.startswith("["):
            kind, detail = "objects", kind[1:-1]
        elif kind[0].isupper():
            kind, detail = "object", kind
        fields.append(Field(name, kind, detail, required))
    return fields


SENSOR = {log_type: parse_fields(text) for log_type, text in SENSOR_FIELDS.items()}
EVENTS = {uid: parse_fields(text) for uid, text in EVENT_FIELDS.items()}
OBJECTS = {name: parse_fields(text) for name, text in OBJECT_RULES.items()}


def input_name(field: str) -> str:
    """``id_orig_h`` arrives as ``id.orig_h``; other names arrive unchanged."""
    return field.replace("_", ".", 1) if field.startswith("id_") else field
