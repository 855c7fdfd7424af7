"""Line rules for text corpora. Patterns stay in the part that Java and RE2 read alike."""

from __future__ import annotations

from lodestone.operators.scan import Rule

RULES = [
    Rule("email-address", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "warning", "security", "high", "CWE-359", needs=("@",)),
    Rule("assigned-secret", r"(?:token|secret|password|api_key)\s*=\s*\"[^\"]+\"", "critical", "security", "high", "CWE-798", r"example|changeme", needs=("=",)),
    Rule("license-line", r"(?:Licensed under|License, [Vv]ersion|All rights reserved)", "info", "style", "high", needs=("Licen", "All rights reserved")),
    Rule("long-number", r"[0-9]{13,19}", "warning", "security", "medium", "CWE-359"),
    Rule("symbol-noise", r"[#*$%&]{3,}", "info", "reliability", "medium"),
    Rule("table-pipes", r"\|[^|]*\|[^|]*\|", "info", "style", "low", needs=("|",)),
    Rule("web-link", r"https?://[^ ]+", "info", "reliability", "low", "CWE-601", needs=("http",)),
    Rule("phone-number", r"\+?[0-9]{2,3}[ -][0-9]{3}[ -][0-9]{4}", "warning", "security", "low", "CWE-359"),
]
COMPLIANCE = [("A01", "CWE-601"), ("A02", "CWE-798"), ("A04", "CWE-359"), ("A07", "CWE-798"), ("A09", "CWE-778")]
