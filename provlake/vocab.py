"""Fixed values.

Word lists, patterns, scores and formats in this file must equal the published ones for results
to agree; they are data, stated as such.  Everything that names the deployed recorder itself is a
parameter (``TOOL``), because it differs between deployments.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: Directory / binary name of the recorder whose own ledger is protected. Deployment parameter.
TOOL = "custody"

# ── fixed values: labels ────────────────────────────────────────────────────────────────────
SENSITIVITY = ("public", "internal", "confidential", "restricted")
FLAGS = ("pii", "credential", "csa-material", "regulated")

# ── fixed values: chain ─────────────────────────────────────────────────────────────────────
GENESIS = "0" * 64
ALGO_KEYED = "hmac-sha256"
ALGO_UNKEYED = "sha256"
CHAIN_FIELDS = ("seq", "prev_hash", "hash", "hash_alg", "keyid")
REQUIRED_CHAIN_FIELDS = ("seq", "prev_hash", "hash", "hash_alg")
SEAL_MAC_PREFIX = "sg-seal-v1:"
ARTIFACT_ID_PREFIX = "sg-artifact-v1:"
SPAN_ID_PREFIX = "otel-id-v1:"
NONCE_SUFFIX = "#sg-nonce"
PROOF_REF_PREFIX = "sg"

# ── fixed values: custody record ────────────────────────────────────────────────────────────
STATEMENT_TYPE = "https://in-toto.io/Statement/v1"
PREDICATE_TYPE = f"https://{TOOL}.example/Custody/v1"
RECORD_VERSION = "1.0.0"
TIER_A = (
    "record.id", "record.at", "record.recorded_at",
    "actor.agent_id", "actor.runtime_action_id", "actor.operator",
    "action.op", "action.method.kind", "action.input_digest",
    "authority.posture",
    "policy.policy_set_digest", "policy.determining_policy",
    "decision.outcome", "decision.channel",
    "lifecycle.session_id",
    "verification.chain", "verification.strength", "verification.known_gaps",
    "alterations",
)
TIER_A_ASSERTIONS = ("alterations", "verification.known_gaps")
TIER_B = (
    "actor.acted_on_behalf_of.prompt_id",
    "decision.basis",
    "authority.capability",
)
OPS = (
    "session.open", "session.close", "prompt.submit", "tool.request", "tool.decision",
    "tool.result", "artifact.identify", "artifact.classify", "artifact.read", "artifact.write",
    "artifact.derive", "artifact.egress", "delegation.scaffold", "delegation.run", "agent.spawn",
    "agent.merge", "custody.handover", "custody.checkpoint", "custody.declassify",
    "custody.alteration", "ledger.seal", "ledger.certify", "caiq.inspect", "caiq.attest",
    "policy.load", "recorder.selfcheck", "proof.run",
)
OUTCOMES = ("allow", "ask", "deny", "defer", "allow-with-conditions")
POSTURES = ("observe", "steer", "bar")
METHOD_KINDS = ("direct-model", "delegated-script", "signed-script", "denied")
DATA_OPS = ("artifact.read", "artifact.write", "artifact.derive", "artifact.egress")
ISOLATED_MIN_TIER = 2
REQUIRED_EVENT_FIELDS = ("op", "at", "actor")
REQUIRED_ASSERTIONS = ("known_gaps", "alterations")

# ── fixed values: alerts ────────────────────────────────────────────────────────────────────
WAKE_HUMAN = {
    "reconciliation-failed":
        "evidence reconciliation failed — the record of what ran cannot be trusted",
    "recorder.selfcheck": "the recorder failed its own integrity check",
    "custody.declassify": "a classification was dropped — a human authorised removing a label",
}
WAKE_OPERATOR = {
    "authorization-refused": "an action was attempted that policy does not permit",
    "artifact.egress": "tainted data left, or attempted to leave, the boundary",
    "custody.alteration": "a record was altered, with justification — confirm the justification",
}
ROUTINE = (
    "session.open", "session.close", "prompt.submit", "tool.request", "tool.decision",
    "tool.result", "artifact.identify", "artifact.classify", "artifact.read", "artifact.write",
    "artifact.derive", "delegation.scaffold", "delegation.run", "agent.spawn", "agent.merge",
    "custody.checkpoint", "custody.handover", "ledger.seal", "ledger.certify", "caiq.inspect",
    "caiq.attest", "policy.load", "dispatch", "turn-complete", "intervention", "provision",
    "teardown",
)


@dataclass(frozen=True)
class Rule:
    """One pattern rule: path classification (with labels) or egress shape (without)."""

    id: str
    pattern: str
    labels: tuple[str, ...] = ()
    reason: str = ""


@dataclass(frozen=True)
class Policy:
    id: str
    effect: str
    when: dict = field(default_factory=dict)
    reason: str = ""
    actions: tuple[str, ...] = ()
    postures: tuple[str, ...] = ()
    guidance: str = ""
    priority: int = 0


# ── fixed values: path classification and egress rules ──────────────────────────────────────
def classify_rules(tool: str = TOOL) -> list[Rule]:
    return [
        Rule("csa-material", r"/work/CSA/|cloudsecurityalliance|/CSA/",
             ("confidential", "csa-material")),
        Rule("credentials",
             r"(^|/)\.env$|(^|/)\.env\.|/\.ssh/|/\.aws/credentials|(^|/)id_(rsa|ed25519)$"
             r"|\.pem$|\.p12$",
             ("restricted", "credential")),
        Rule("keys-and-tokens", r"secret|token|apikey|api_key|password|passwd|keyfile",
             ("restricted", "credential")),
        Rule("roster-and-people",
             r"roster|attendee|member|employee|payroll|contact.*\.csv|people.*\.csv",
             ("restricted", "pii")),
        Rule("customer-data", r"customer|client|patient|student|subscriber",
             ("confidential", "pii")),
        Rule("regulated-exports", r"\.(sql|dump|bak)$|dump\.|backup.*\.(tar|zip|gz)$",
             ("confidential", "regulated")),
        Rule("ledger-self", rf"/\.{tool}/|{tool}/ledger|proofs\.jsonl",
             ("restricted", "credential")),
        Rule("source-code", r"\.(py|ts|js|go|rs|sh)$", ("internal",)),
    ]


EGRESS_RULES = [
    Rule("http-post",
         r"curl[^|]*(-X\s*(POST|PUT|PATCH)|--data|-d\s|-F\s|--upload-file)|wget[^|]*--post",
         reason="Outbound HTTP carrying a body."),
    Rule("object-storage",
         r"\b(aws\s+s3|gsutil|az\s+storage|rclone|s3cmd)\b.*\b(cp|sync|mv|put)\b",
         reason="Object-storage upload."),
    Rule("remote-copy", r"\b(scp|rsync|sftp)\b.*:", reason="Remote copy to a host."),
    Rule("git-push", r"git\s+push", reason="Pushing to a remote."),
    Rule("pipe-to-network", r"\|\s*(nc|ncat|netcat|socat)\b",
         reason="Piping into a network tool."),
    Rule("mail", r"\b(mail|sendmail|mutt|msmtp)\b", reason="Outbound mail."),
]

# ── fixed values: paths mentioned in a call ─────────────────────────────────────────────────
PATH_KEYS = ("file_path", "path", "notebook_path")
PATH_LIST_KEYS = ("file_paths", "paths")
COMMAND_PATH_PATTERNS = (
    r"""(?:^|[\s="'])((?:/|~/|\./)[\w./~@%+-]+)""",
    r"""(?:^|[\s="'<>|])([\w][\w.@%+-]*\.[A-Za-z][\w]{0,8})""",
    r"""[12]?>>?\s*([\w./~@%+-]+)""",
)
WRITE_TOOLS = ("Write", "Edit", "NotebookEdit")

# ── fixed values: policy set (file stem # id), in file and declaration order ────────────────
POLICIES = [
    Policy("10-base#allow-unclassified", "permit", {"artifact.classified": {"is_false": True}},
           "The artifact carries no classification; ordinary work proceeds "
           "unrecorded-as-custody."),
    Policy("10-base#allow-non-data-ops", "permit", {}, "Housekeeping ops touch no artifact.",
           actions=("session.open", "session.close", "prompt.submit", "policy.load",
                    "caiq.inspect", "custody.checkpoint", "recorder.selfcheck", "proof.run",
                    "ledger.seal")),
    Policy("10-base#allow-own-cli", "permit", {"call.is_own_binary": {"is_true": True}},
           "The recorder's own binary, recognised by resolved path and pinned digest."),
    Policy("10-base#observe-records-does-not-block", "permit", {},
           "Observe records everything and blocks nothing.", postures=("observe",)),
    Policy("20-steer#classified-first-touch", "ask",
           {"artifact.classified": {"is_true": True}, "artifact.first_touch": {"is_true": True}},
           "This artifact is classified. Opening it directly puts its contents into the model's "
           "context.", postures=("steer",), guidance="delegate"),
    Policy("20-steer#classified-subsequent-touch", "permit",
           {"artifact.classified": {"is_true": True}, "artifact.first_touch": {"is_false": True}},
           "Already touched this session; the taint is already recorded and carried.",
           postures=("steer",)),
    Policy("20-steer#delegated-script-permitted", "permit",
           {"call.delegated_script.test_passed": {"is_true": True}},
           "Handling is delegated to a deterministic script whose paired test passed.",
           postures=("steer", "bar")),
    Policy("30-classified#forbid-tainted-egress", "forbid",
           {"call.is_egress": {"is_true": True}, "session.taint_depth": {"gte": 1}},
           "This session holds classified taint and this call sends data outward.",
           postures=("steer", "bar")),
    Policy("30-classified#forbid-credential-egress", "forbid",
           {"call.is_egress": {"is_true": True}, "session.taint": {"contains": "credential"}},
           "Credential material does not leave the host under an enforcement posture.",
           postures=("steer", "bar"), priority=10),
    Policy("30-classified#forbid-accumulation-threshold", "forbid",
           {"session.taint_depth": {"gte": 4}, "artifact.classified": {"is_true": True}},
           "This session has accumulated classified material from several distinct artifacts.",
           postures=("steer", "bar")),
    Policy("30-classified#forbid-ledger-write", "forbid",
           {"artifact.is_ledger": {"is_true": True}, "call.is_write": {"is_true": True},
            "call.protect_ledger": {"is_true": True}},
           "The evidence ledger is not writable through the agent under any posture."),
    Policy("40-bar#forbid-direct-classified-read", "forbid",
           {"artifact.classified": {"is_true": True},
            "call.delegated_script.signed": {"is_false": True}},
           "Under `bar` the model does not open classified artifacts.",
           postures=("bar",), guidance="signed-script"),
    Policy("40-bar#permit-signed-script", "permit",
           {"call.delegated_script.signed": {"is_true": True},
            "call.delegated_script.test_passed": {"is_true": True}},
           "Signed script under a key the model cannot reach.", postures=("bar",)),
]
EFFECT_PRECEDENCE = {"forbid": 3, "ask": 2, "permit": 1}
EFFECT_OUTCOME = {"forbid": "deny", "ask": "ask", "permit": "allow"}
DEFAULT_DENY_ID = "default#deny-by-default"
DEFAULT_DENY_REASON = "no policy permitted this action — deny by default"
DEFAULT_POSTURE = "observe"
NON_INTERRUPTING_MODES = ("bypassPermissions", "acceptEdits")

# ── fixed values: command risk ──────────────────────────────────────────────────────────────
CONTEXT_MULTIPLIERS = {"project": 1.0, "home": 1.3, "system": 1.8, "root": 2.5}
TIERS = (("Safe", 20), ("Caution", 50), ("Danger", 80), ("Critical", 100))
# (pattern, penalty, reason)
FLAG_PENALTIES = (
    (r"(-rf|-fr|--recursive.*--force|--force.*--recursive)\b", 20,
     "recursive+force combo removes without confirmation"),
    (r"--no-verify\b", 15, "explicitly bypasses a safety hook"),
    (r"(^|\s)-y(\s|$)|--yes\b|--assume-yes\b", 10,
     "auto-confirms, removing the human checkpoint"),
    (r"--force\b(?!.*--force-with-lease)", 15, "overrides a normal safety check"),
)
# (pattern, intent, base score, category, reason)
RISK_RULES = (
    (r"\brm\s+.*-[a-z]*r[a-z]*f|\brm\s+.*-[a-z]*f[a-z]*r", "delete", 40, "Blast Radius",
     "recursive forced delete"),
    (r"\brm\s+-[a-z]*f", "delete", 25, "Blast Radius", "forced delete, no confirmation"),
    (r"\bdd\s+.*of=/dev/", "delete", 50, "Blast Radius",
     "raw block-device write, can destroy a whole disk"),
    (r"\bmkfs(\.|\s)", "delete", 50, "Blast Radius", "formats a filesystem"),
    (r"\bdiskutil\s+(erase|reformat)", "delete", 45, "Blast Radius", "erases a disk/volume"),
    (r"\bgit\s+push\s+.*--force(?!-with-lease)", "write", 30, "Untraceability",
     "force-push can overwrite remote history"),
    (r"\bgit\s+reset\s+--hard", "delete", 20, "Blast Radius", "discards uncommitted work"),
    (r"\bgit\s+clean\s+.*-[a-z]*f[a-z]*d|\bgit\s+clean\s+.*-[a-z]*d[a-z]*f", "delete", 20,
     "Blast Radius", "deletes untracked files/dirs"),
    (r"(curl|wget)[^|]*\|\s*(sh|bash|zsh|python3?|node|perl|ruby)\b", "execute", 45,
     "Supply Chain", "executes remote content without inspection"),
    (r"\bbase64\s+(-d|--decode|-D)\b", "execute", 20, "Untraceability",
     "decodes an opaque blob before use"),
    (r"\bsudo\s+", "privilege", 20, "Critical System Interaction",
     "elevates privilege for the command"),
    (r"\bchmod\s+.*777|\bchmod\s+.*-R\s+777", "privilege", 20, "Critical System Interaction",
     "world-writable permissions"),
    (r"\bchown\s+.*-R\s+", "privilege", 15, "Critical System Interaction",
     "recursive ownership change"),
    (r"\bcat\s+.*\.(ssh/id_rsa|ssh/id_ed25519|aws/credentials|env)\b", "read", 15,
     "Credential Exposure", "reads a credential file into the transcript"),
    (r"\bnc\s+-l|\bnetcat\s+-l|\bncat\s+-l", "network", 25, "Blast Radius",
     "opens a listening network socket"),
    (r"\bssh-keygen\s+.*-f\s+.*id_", "write", 15, "Credential Exposure",
     "generates/overwrites a key file"),
    (r"\bkill\s+-9\s+1\b|\bkillall\s+-9\s+launchd", "privilege", 40,
     "Critical System Interaction", "targets the init process"),
    (r"\bnpm\s+publish\b|\bpip\s+.*upload\b|\btwine\s+upload\b", "network", 30, "Supply Chain",
     "publishes a package publicly"),
    (r"\bcrontab\s+-r\b", "delete", 20, "Blast Radius", "removes all scheduled jobs"),
    (r"\biptables\s+-F\b|\bpfctl\s+-F\b", "privilege", 25, "Critical System Interaction",
     "flushes firewall rules"),
    (r"\bdefaults\s+delete\b", "delete", 15, "Blast Radius",
     "removes a system preference domain"),
    (r"\bshutdown\b|\breboot\b|\bhalt\b", "privilege", 20, "Critical System Interaction",
     "affects whole-system availability"),
)
# (pattern, sensitivity, reason)
FILESET_SENSITIVITY = (
    (r"\.env(\.|$)", "high", "environment/secrets file"),
    (r"\.ssh/", "high", "SSH key material"),
    (r"(^|/)\.aws/", "high", "cloud credentials"),
    (r"_rsa$|_ed25519$|\.pem$|\.p12$|\.pfx$", "high", "private key material"),
    (r"credentials|secrets\.json|\.npmrc$|\.pypirc$", "high", "stored credentials/tokens"),
    (r"(^|/)\.git/", "medium", "repo internals, not typically hand-edited"),
)
UNMATCHED_REASON = "no seed rule matched"
RISK_TARGET_PATTERN = r"((?:/[A-Za-z0-9_.~-]+)+)"
RISK_MARKER = r"# *risk-ok"
GUARD_MARKER = r"# *noodle-ok"
# (shape, pattern); a later match overrides an earlier one
GUARD_SHAPES = (
    ("fetch-pipe-parser", r"(curl|wget)[^|\n]*\|[^\S\n]*(python3?|jq|node|perl|ruby)\b"),
    ("base64-decode", r"\bbase64[^\S\n]+(-d|--decode|-D)\b"),
)
BUILD_PATHS = r"(?s)^.*/scripts/.*\.(py|sh|js|ts|rb)$|^.*/workflows/.*\.json$"
BUILD_TEST_NAMES = r"(?s)^(test_.*|.*_test\.py|.*\.test\.js|.*\.test\.ts)$"
BUILD_MARKER = r"(?:#|//) *build-ok:([^\n]*)"
BUILD_SEARCHED = r"(workflows|scripts|commands|\.json|\.py|\.ts|\.sh|/)"
BUILD_MIN_CHARS = 60
OBSERVATION_CAP = 5000
CANDIDATE_TOKENS, CANDIDATE_MIN_LEN, CANDIDATE_HITS = 6, 4, 4
TEMP_PATH_PATTERN = r"""/(?:private/)?(?:tmp|var/folders)[^\s"']*sg-replay-[^\s"']*"""

# ── fixed values: evidence ──────────────────────────────────────────────────────────────────
CLAIM_DEFINITION_FIELDS = ("id", "statement", "surface", "proof_kind", "aicm", "must_touch",
                           "milestone", "witness_mode")
WITNESS_MIN_MODULES, WITNESS_MIN_CALLS = 1, 25
LIVE_SESSION_KINDS = ("plugin", "skill", "command")
SCOPE_FIELDS = ("surface", "aicm")
SCOPE_OP, RETRACTION_OP = "claim.scope", "claim.scope.retract"
DSSE_PAYLOAD_TYPE = "application/vnd.in-toto+json"

# ── fixed values: sufficiency ───────────────────────────────────────────────────────────────
REGIMES = {
    "actor": ("actor.agent_id", "actor.operator", "actor.runtime_action_id"),
    "authority": ("authority.posture", "authority.capability"),
    "action": ("action.op", "action.method.kind", "action.input_digest"),
    "policy": ("policy.policy_set_digest", "policy.determining_policy"),
    "decision_basis": ("decision.outcome", "decision.basis"),
    "resource_touch": ("resources.used",),
    "lifecycle": ("lifecycle.session_id", "lifecycle.prompt_id"),
    "verification": ("verification.chain", "verification.strength", "verification.known_gaps"),
}
QUESTIONS = {
    "who acted, on whose authority": ("actor", "authority", "lifecycle"),
    "what data was touched, and where did it go": ("action", "resource_touch", "verification"),
    "why was this permitted or refused": ("policy", "decision_basis", "authority"),
    "can this record be trusted": ("verification", "actor", "lifecycle"),
}
ASSERTION_PATHS = ("verification.known_gaps", "alterations")
REGIME_OPS = {
    "resource_touch": ("artifact.read", "artifact.write", "artifact.derive", "artifact.egress",
                       "tool.result"),
    "decision_basis": ("tool.decision", "artifact.read", "artifact.write", "artifact.egress"),
    "policy": ("tool.decision", "artifact.read", "artifact.write", "artifact.egress"),
}

# ── fixed values: questionnaire; the two answer texts are this deployment's own and can be passed ─
NEGATIVE_CONTROLS = {
    "LOG-12": "No. No continuous activity log exists for key lifecycle events.",
    "STA-09": "No. A service bill of materials is not emitted.",
}
PROPOSED_CONTROLS = ("IAM-AG-03", "LOG-AG-01", "LOG-AG-02", "AG-GV.2", "AG-GV.3")
RELEASE_ATTESTATION_CLAIMS = ("CLAIM-21",)
DEFAULT_OWNER = "Owned by OSP"
VALID_ANSWERS = ("Yes", "No", "NA")
VALID_OWNERS = (
    "Owned by CSP", "Owned by MP", "Owned by OSP", "Owned by AP", "Owned by AIC",
    "Shared across the supply chain", "Shared CSP-MP", "Shared MP-OSP",
    "Shared OSP-AP", "Shared AP-AIC", "Not Determined",
)

# ── fixed values: provenance exports ────────────────────────────────────────────────────────
PROV_PREFIX = {"entity": "sg:artifact/", "activity": "sg:activity/", "agent": "sg:agent/",
               "person": "sg:person/"}
SPAN_NS = "csa.coc"
SPAN_KIND_INTERNAL = 1
STATUS_OK, STATUS_ERROR = 1, 2

# ── fixed values: call-site audit ───────────────────────────────────────────────────────────
NETWORK_PATTERNS = (
    ("urllib", r"\burllib\.request\b|\burlopen\b"),
    ("requests", r"\brequests\.(get|post|put|patch|delete|head|request)\b"),
    ("httpx", r"\bhttpx\.(get|post|put|Client|AsyncClient)\b"),
    ("socket", r"\bsocket\.(socket|create_connection)\b"),
    ("http.client", r"\bhttp\.client\.(HTTPConnection|HTTPSConnection)\b"),
    ("aiohttp", r"\baiohttp\."),
    ("ftplib", r"\bftplib\b"),
    ("smtplib", r"\bsmtplib\b"),
    ("curl-subprocess",
     r"""\[\s*["'](?:/usr/bin/)?(?:curl|wget)["']|["'](?:curl|wget)["']\s*,"""),
)
LOCAL_IPC_PATTERN = r"\bAF_UNIX\b"
LOCAL_ROOT_PATTERN = r"/Users/[A-Za-z0-9_.-]+/(?:Software|DockProjects)/[A-Za-z0-9_.-]+"
OUTSTANDING_TOP, WEAK_IDS_SHOWN = 6, 12


@dataclass(frozen=True)
class RiskRules:
    """What a risk score is made of; the defaults of ``operators.risk`` are the published ones."""
    rules: tuple = RISK_RULES
    flag_penalties: tuple = FLAG_PENALTIES
    tiers: tuple = TIERS
    context_multipliers: dict = field(default_factory=lambda: dict(CONTEXT_MULTIPLIERS))
    fileset_sensitivity: tuple = FILESET_SENSITIVITY


PUBLISHED_RISK = RiskRules()
