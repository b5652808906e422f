"""Rules, callers and limits.

All of these are operator-written configuration: a handful of rows, held as Python values and put
into plans as literals or as local relations whose size is known before the job starts.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, fields

from shroudline.functions import ranks, regex

MAX_CONFIG_ROWS = 100_000


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    pattern: str
    severity: str = "medium"
    authorized_action: str = "allow"
    unauthorized_action: str = "redact"
    min_clearance: str = "internal"
    masking: str = "placeholder"


@dataclass(frozen=True)
class EntropyRule:
    label: str = "secret_like"
    severity: str = "high"
    authorized_action: str = "redact"
    unauthorized_action: str = "block"
    min_clearance: str = "confidential"
    masking: str = "hash"
    min_length: int = 20
    min_entropy: float = 3.6
    name: str = "high_entropy"


@dataclass(frozen=True)
class EntityRule:
    """How findings of an outside recogniser are labelled and judged."""

    entity_type: str
    label: str
    severity: str = "medium"
    authorized_action: str = "allow"
    unauthorized_action: str = "redact"
    min_clearance: str = "internal"
    masking: str = "placeholder"
    min_score: float = 0.35

    @property
    def name(self) -> str:
        return f"presidio:{self.entity_type}"


@dataclass(frozen=True)
class Principal:
    name: str
    tenant_id: str
    role: str
    clearance: str = "internal"
    secret_sha256: str | None = None
    allowed_labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class PolicyRule:
    """One external policy row: NULL fields match anything."""

    action: str
    reason: str
    direction: str | None = None
    label: str | None = None
    role_not: str | None = None
    session_escalated: bool | None = None


@dataclass(frozen=True)
class HostRule:
    list: str  # floor | passthrough | intercept | signs_body
    kind: str  # exact | wildcard | regex
    value: str
    version: int = 0


# The stock detection rules.
DEFAULT_RULES = (
    Rule("email", "email", r"(?i)(?:^|[^A-Z0-9._%+-])([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})(?:$|[^A-Z0-9._%+-])",
         "medium", "allow", "redact", "internal", "partial_email"),
    Rule("phone_cn", "phone", r"(?:^|[^0-9])(1[3-9]\d{9})(?:$|[^0-9])",
         "high", "allow", "block", "confidential", "partial_phone"),
    Rule("china_national_id", "national_id", r"(?:^|[^0-9Xx])(\d{17}[\dXx])(?:$|[^0-9Xx])",
         "critical", "allow", "block", "restricted", "keep_last4"),
    Rule("ip_address", "ip_address",
         r"(?:^|[^0-9.])((?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3})(?:$|[^0-9.])",
         "medium", "allow", "redact", "internal", "placeholder"),
    Rule("mac_address", "mac_address", r"(?i)(?:^|[^0-9A-F])((?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2})(?:$|[^0-9A-F])",
         "high", "allow", "redact", "confidential", "placeholder"),
    Rule("imei", "imei", r"(?:^|[^0-9])(\d{15})(?:$|[^0-9])",
         "critical", "allow", "block", "restricted", "keep_last4"),
    Rule("vin", "vin", r"(?i)(?:^|[^A-HJ-NPR-Z0-9])([A-HJ-NPR-Z0-9]{17})(?:$|[^A-HJ-NPR-Z0-9])",
         "high", "allow", "redact", "confidential", "placeholder"),
    Rule("bank_card", "bank_card", r"(?:^|[^0-9])(\d{16,19})(?:$|[^0-9])",
         "critical", "redact", "block", "restricted", "keep_last4"),
    Rule("openai_key", "api_key", r"(?:^|[^A-Za-z0-9-])(sk-[A-Za-z0-9]{20,})(?:$|[^A-Za-z0-9-])",
         "critical", "redact", "block", "restricted", "hash"),
    Rule("bearer_token", "bearer_token", r"(?i)Bearer\s+[A-Za-z0-9._\-]{16,}",
         "critical", "redact", "block", "restricted", "hash"),
)

DEFAULT_ENTROPY = EntropyRule()

# The caller used where nobody is authenticated.
LOCAL_PRINCIPAL = Principal("local", "local", "local", "public")

# The three stock policy rows.
DEFAULT_POLICY_RULES = (
    PolicyRule("block", "OPA policy blocks bearer_token for non-admin callers",
               direction="request", label="bearer_token", role_not="admin"),
    PolicyRule("review", "OPA escalates multi-turn sessions touching national_id",
               direction="request", label="national_id", session_escalated=True),
    PolicyRule("redact", "OPA forces response redaction when secret_like appears",
               direction="response", label="secret_like"),
)

# Provider hosts that are always intercepted.
FLOOR_HOSTS = (
    HostRule("floor", "exact", "api.openai.com"),
    HostRule("floor", "wildcard", "*.openai.azure.com"),
    HostRule("floor", "wildcard", "*.cognitiveservices.azure.com"),
    HostRule("floor", "wildcard", "*.services.ai.azure.com"),
    HostRule("floor", "exact", "api.anthropic.com"),
    HostRule("floor", "exact", "generativelanguage.googleapis.com"),
    HostRule("floor", "exact", "aiplatform.googleapis.com"),
    HostRule("floor", "regex", r"^bedrock-runtime\.[a-z0-9-]+\.amazonaws\.com$"),
    HostRule("floor", "exact", "api.deepseek.com"),
    HostRule("floor", "exact", "api.moonshot.ai"),
    HostRule("floor", "exact", "api.moonshot.cn"),
    HostRule("floor", "exact", "api.groq.com"),
    HostRule("floor", "exact", "api.mistral.ai"),
    HostRule("floor", "exact", "api.cohere.com"),
    HostRule("floor", "exact", "api.x.ai"),
    HostRule("floor", "exact", "openrouter.ai"),
)

# Hosts passed through unless configured otherwise.
PASSTHROUGH_HOSTS = (
    HostRule("passthrough", "exact", "chatgpt.com"),
    HostRule("passthrough", "wildcard", "*.chatgpt.com"),
    HostRule("passthrough", "exact", "chat.openai.com"),
    HostRule("passthrough", "wildcard", "*.auth0.com"),
    HostRule("passthrough", "exact", "challenges.cloudflare.com"),
    HostRule("passthrough", "exact", "desktop.chat.openai.com"),
    HostRule("passthrough", "exact", "ios.chat.openai.com"),
    HostRule("passthrough", "exact", "android.chat.openai.com"),
    HostRule("passthrough", "exact", "claude.ai"),
    HostRule("passthrough", "wildcard", "*.claude.com"),
    HostRule("passthrough", "exact", "gemini.google.com"),
    HostRule("passthrough", "exact", "aistudio.google.com"),
)

# Hosts whose request body carries a signature.
SIGNED_HOSTS = (
    HostRule("signs_body", "regex", r"^bedrock-runtime\.[a-z0-9-]+\.amazonaws\.com$"),
    HostRule("signs_body", "regex", r"^bedrock-mantle\.[a-z0-9-]+\.api\.aws$"),
)


@dataclass(frozen=True)
class Detection:
    rules: tuple[Rule, ...] = DEFAULT_RULES
    high_entropy: EntropyRule | None = DEFAULT_ENTROPY
    entities: tuple[EntityRule, ...] = ()
    ignore_json_pointers: tuple[str, ...] = ()

    def __post_init__(self):
        for rule in self.rules:
            try:
                regex.accepted(rule.pattern)
            except re.error as error:
                raise ValueError(f"rule {rule.name}: {error}") from error
        for rule in self.scored:
            _check_rule(rule)

    @property
    def scored(self) -> tuple:
        """Every rule that can label a finding, in finding order."""
        return (*self.rules, *((self.high_entropy,) if self.high_entropy else ()))


def _check_rule(rule) -> None:
    for value, names in (
        (rule.severity, ranks.SEVERITIES),
        (rule.authorized_action, ranks.ACTIONS),
        (rule.unauthorized_action, ranks.ACTIONS),
        (rule.min_clearance, ranks.CLEARANCES),
        (rule.masking, ranks.MASKINGS),
    ):
        if value not in names:
            raise ValueError(f"rule {rule.name}: {value!r} is none of {names}")


def _pick(cls, row: dict):
    known = {f.name for f in fields(cls)}
    given = {key: tuple(value) if isinstance(value, list) else value for key, value in row.items() if key != "enabled"}
    if unknown := sorted(set(given) - known):
        raise ValueError(f"{cls.__name__} {row.get('name', '')}: unknown keys {unknown}")
    return cls(**given)


def detection_from(document: dict) -> Detection:
    """Detection settings from a parsed configuration or rule bundle."""
    section = document.get("detection", document)
    entropy = section.get("high_entropy")
    return Detection(
        rules=tuple(_pick(Rule, row) for row in section.get("rules", [])),
        high_entropy=_pick(EntropyRule, entropy) if entropy and entropy.get("enabled", True) else None,
        entities=tuple(_pick(EntityRule, row) for row in (section.get("presidio") or {}).get("entities", [])),
        ignore_json_pointers=tuple(section.get("ignore_json_pointers", ())),
    )


def principals_from(document: dict) -> tuple[Principal, ...]:
    return tuple(_pick(Principal, row) for row in document.get("auth", document).get("principals", []))


def policy_rules_from(document: dict) -> tuple[PolicyRule, ...]:
    """External policy rows under ``policy.rules``."""
    rules = tuple(_pick(PolicyRule, row) for row in document.get("policy", document).get("rules", []))
    for rule in rules:
        if rule.action not in ranks.ACTIONS:
            raise ValueError(f"policy rule: {rule.action!r} is none of {ranks.ACTIONS}")
    return rules


def hosts_from(document: dict) -> tuple[HostRule, ...]:
    """Host rules under ``hosts``, a list of texts per list name: ``*.x`` is a wildcard, ``/x/`` a pattern, else exact."""
    out = []
    for name, values in document.get("hosts", {}).items():
        if name not in ("floor", "passthrough", "intercept", "signs_body"):
            raise ValueError(f"unknown host list {name!r}")
        for value in values:
            if len(value) > 1 and value.startswith("/") and value.endswith("/"):
                out.append(HostRule(name, "regex", regex.check(value[1:-1])))
            else:
                out.append(HostRule(name, "wildcard" if value.startswith("*.") else "exact", value))
    return tuple(out)


def limits_from(document: dict, **defaults: int) -> dict[str, int]:
    """Whole, positive limits under ``limits`` over ``defaults``; names without a default are refused."""
    given = document.get("limits", {})
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown limits {unknown}")
    if bad := [k for k, v in given.items() if isinstance(v, bool) or not isinstance(v, int) or v < 1]:
        raise ValueError(f"limits {bad} must be whole and positive")
    return {**defaults, **given}


def parse_document(text: str, kind: str = "json") -> dict:
    """A JSON, TOML or YAML configuration text; YAML only where a parser is installed."""
    if kind in ("yaml", "yml"):
        import yaml

        return yaml.safe_load(text)
    if kind == "toml":
        import tomllib

        return tomllib.loads(text)
    return json.loads(text)


def as_rows(items) -> list[dict]:
    rows = [asdict(item) for item in items]
    if len(rows) > MAX_CONFIG_ROWS:
        raise ValueError(f"{len(rows)} configuration rows, at most {MAX_CONFIG_ROWS} are allowed")
    return rows
