"""Word lists of the name detectors.

Fixed values: results depend on exactly these words.
"""

from __future__ import annotations

#: Words that no name holds.
NON_NAMES = (
    "activity", "trends", "success", "teams", "support", "operations", "summary", "during",
    "archival", "references", "interaction", "session", "profile", "feedback", "engagement",
    "following", "gathered", "latest", "product", "update", "service", "request", "portal",
    "engine", "billing", "internal", "analytics", "dashboard", "tracking", "feature",
    "adoption", "customer", "user", "client", "data", "review", "process", "system",
    "compliance", "infrastructure", "quarterly", "marketing", "engineering", "finance",
    "security", "verified", "identity", "agent", "case", "account", "description",
)
#: And those of page layouts.
PAGE_NON_NAMES = (*NON_NAMES, "assistance", "raised", "regarding", "recent", "included", "and", "phone", "email")

#: What stands before a name, and what may follow it.
ROLES = (
    "customer", "user", "client", r"referenced\s+customer", r"for\s+customer", r"linked\s+to\s+customer",
    "agent", "officer", "analyst", "investigator", "reviewer", "auditor", "examiner",
    r"senior\s+analyst", r"reviewing\s+officer", r"fraud\s+team\s+led\s+by", r"led\s+by",
    r"point\s+of\s+contact\s+(?:for\s+this\s+review\s+)?is", r"prepared\s+by", r"handled\s+by", r"conducted\s+by",
    r"escalated\s+by", r"interviewed\s+by", r"contact\s+(?:for\s+this\s+review\s+)?is",
)
FOLLOWERS = (
    "from", "via", "using", "at", "regarding", "contacted", "email", "phone", r"\(", "IP", "on", "noted", "handled",
    "confirmed", "initiated", "escalated", "denied", "can", "after", "who", "reported", "reachable", "and",
)
#: Names of fields that a scan asks about.
FIELD_HINTS = ("IFSC", "SWIFT", "VPA", "UPI", "IBAN", "NPI", "DEA", "DL", "License", "Licence", "Reg(?:istration)?", "MRN", "PatientID", "EmployeeID", "StaffID")
