"""The built-in catalogue of sensitive-data patterns."""

from __future__ import annotations

from typing import NamedTuple


class Group(NamedTuple):
    """Patterns that are reported under one name, and what a match must pass."""

    name: str
    patterns: tuple[str, ...]
    negatives: tuple[str, ...] = ()
    negatives_are_keywords: bool = False
    min_occurrences: int = 1
    min_unique_chars: int = 0
    validator: str | None = None
    keywords: bool = False


#: Words near a match that mark it as a placeholder.
PLACEHOLDERS = ("example", "sample", "placeholder", "dummy", "fake", "test", "xxx", "your_", "your-", "insert", "replace", "change_me", "CHANGE_ME", "todo", "fixme", "<your", "{your", "mock", "template")

#: The patterns, in the order in which groups claim a match.
BUILTIN = (
    Group(
        "API Keys",
        (
            r"\bsk-[a-zA-Z0-9]{20,}\b",
            r"\bsk-proj-[a-zA-Z0-9\-_]{20,}\b",
            r"\bsk-ant-[a-zA-Z0-9\-_]{20,}\b",
            r"\bAKIA[0-9A-Z]{16}\b",
            r"\bghp_[a-zA-Z0-9]{36}\b",
            r"\bgho_[a-zA-Z0-9]{36}\b",
            r"\bghu_[a-zA-Z0-9]{36}\b",
            r"\bghs_[a-zA-Z0-9]{36}\b",
            r"\bghr_[a-zA-Z0-9]{36}\b",
            r"\bgithub_pat_[a-zA-Z0-9_]{22,}\b",
            r"\bxox[baprs]-[a-zA-Z0-9\-]{10,}\b",
            r"\bxapp-[0-9]+-[A-Za-z0-9\-]+\b",
            r"\bsk_live_[a-zA-Z0-9]{24,}\b",
            r"\bsk_test_[a-zA-Z0-9]{24,}\b",
            r"\bpk_live_[a-zA-Z0-9]{24,}\b",
            r"\bpk_test_[a-zA-Z0-9]{24,}\b",
            r"\brk_live_[a-zA-Z0-9]{24,}\b",
            r"\brk_test_[a-zA-Z0-9]{24,}\b",
            r"\bAIza[0-9A-Za-z\-_]{35}\b",
            r"\bya29\.[0-9A-Za-z\-_]+\b",
            r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----",
            r"-----BEGIN\s+OPENSSH\s+PRIVATE\s+KEY-----",
            r"-----BEGIN\s+EC\s+PRIVATE\s+KEY-----",
            r"-----BEGIN\s+DSA\s+PRIVATE\s+KEY-----",
            r"-----BEGIN\s+PGP\s+PRIVATE\s+KEY\s+BLOCK-----",
            r"\bSG\.[a-zA-Z0-9_\-]{22,}\.[a-zA-Z0-9_\-]{22,}\b",
            r"\bAC[a-f0-9]{32}\b",
            r"\bSK[a-f0-9]{32}\b",
            r"https://discord(?:app)?\.com/api/webhooks/\d+/[A-Za-z0-9_\-]+",
            r"https://hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[a-zA-Z0-9]+",
            r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
        ),
        PLACEHOLDERS,
        negatives_are_keywords=True,
        min_unique_chars=10,
    ),
    Group(
        "AWS Credentials",
        (
            r"(?i)(?:aws_secret_access_key|aws_secret|secret_access_key)\s*[=:]\s*[A-Za-z0-9/+=]{40}",
        ),
        (r"(?i)example|sample|placeholder|dummy|fake|test|xxx|your.|insert|replace|change.me|todo|fixme|mock|template|wJalrXUtnFEMI",),
        min_unique_chars=12,
    ),
    Group(
        "Database Credentials",
        (
            r"""\bpostgres(?:ql)?://[^:/\s@]+:[^@\s"'`\\\[\]\{\}<>,]{6,}@[^/\s"'`\\\[\]\{\}<>]+(?:/[^\s"'`\\]*)?""",
            r"""\bmysql://[^:/\s@]+:[^@\s"'`\\\[\]\{\}<>,]{6,}@[^/\s"'`\\\[\]\{\}<>]+(?:/[^\s"'`\\]*)?""",
            r"""\bmongodb(?:\+srv)?://[^:/\s@]+:[^@\s"'`\\\[\]\{\}<>,]{6,}@[^/\s"'`\\\[\]\{\}<>]+(?:/[^\s"'`\\]*)?""",
            r"""(?i)\bServer=[A-Za-z0-9._:,\\-]+;(?:[^;\n\r]*;)*(?:Password|Pwd)=[^;\s"'`\\\[\]\{\}<>,]{4,}""",
            r"""(?i)\bjdbc:[a-z0-9]+://[^\s"'`\\]+(?:\?|;)[^\n\r]*(?:password|pwd)=[^&;\s"'`\\\[\]\{\}<>,]{4,}""",
            r"""(?i)\b(?:db|database|postgres|mysql|mongo|redis|mssql|sql)_?password\s*[=:]\s*["']?[^,\s"'`\\\[\]\{\}<>]{8,}["']?""",
        ),
        (r"(?i)example\.com|localhost|127\.0\.0\.1|placeholder|dummy|fake|your.|sample|template|password123|changeme|xxxx|test_?db|mock|todo|\$\{|%s|\{\{",),
        min_unique_chars=8,
    ),
    Group(
        "Redis Credentials",
        (
            r"""\brediss?://(?:[^:/\s@]+:|:)[^@\s"'`\\\[\]\{\}<>,]{6,}@[^/\s"'`\\\[\]\{\}<>]+(?:/[^\s"'`\\]*)?""",
        ),
        (r"(?i)example\.com|localhost|127\.0\.0\.1|placeholder|dummy|fake|your.|sample|template|password123|changeme|xxxx|test_?db|mock|todo|\$\{|%s|\{\{",),
        min_unique_chars=8,
    ),
    Group(
        "Generic Secret Assignments",
        (
            r"(?i)(?:secret_key|api_secret|auth_token|access_token|api_token|private_key|encryption_key|signing_key)\s*[=:]\s*[A-Za-z0-9/+=\-_]{16,}",
        ),
        (r"(?i)example|placeholder|dummy|fake|your.|sample|template|xxxx|mock|todo|fixme|os\.environ|os\.getenv|process\.env|\$\{|%s|\{\{|ENV\[|config\.",),
        min_unique_chars=10,
    ),
    Group(
        "Aadhaar Number (India)",
        (
            r"\b[2-9][0-9]{3}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}\b",
        ),
        (r"(?i)example|sample|placeholder|dummy|fake|test|xxxx|mock|template|0000.?0000.?0000|1111.?1111.?1111|1234.?5678.?9012",),
        min_unique_chars=4,
        validator="verhoeff",
    ),
    Group(
        "PAN Card (India)",
        (
            r"\b[A-Z]{3}[PCHABGJLFT][A-Z][0-9]{4}[A-Z]\b",
        ),
        (r"(?i)example|sample|placeholder|dummy|fake|test|mock|template|ABCDE1234F|AAAAA\d{4}A",),
        min_unique_chars=4,
    ),
    Group(
        "Indian Passport Number",
        (
            r"(?i)(?:passport|travel\s*doc(?:ument)?|pp\s*no|passport\s*(?:no|number|#))\s*[:\-]?\s*[J-Zj-z][0-9]{7}\b",
        ),
        (r"(?i)example|sample|placeholder|dummy|fake|test|mock|template",),
        min_unique_chars=4,
    ),
    Group(
        "Voter ID / EPIC (India)",
        (
            r"(?i)(?:voter\s*id|epic|election\s*(?:card|id))\s*[:\-#]?\s*[A-Za-z]{3}[0-9]{7}\b",
        ),
        (r"(?i)example|sample|placeholder|dummy|fake|test|mock|template",),
        min_unique_chars=4,
    ),
    Group(
        "Driving License (India)",
        (
            r"\b[A-Z]{2}[\-\s]?[0-9]{2}[\-\s]?(?:19|20)[0-9]{2}[\-\s]?[0-9]{7}\b",
        ),
        (r"(?i)example|sample|placeholder|dummy|fake|test|mock|template",),
        min_unique_chars=4,
    ),
    Group(
        "Social Security Number (USA)",
        (
            r"\b(?:00[1-9]|0[1-9][0-9]|[1-5][0-9]{2}|6[0-57-9][0-9]|66[0-57-9]|[7-8][0-9]{2})[\-\s](?:0[1-9]|[1-9][0-9])[\-\s](?:[0-9]{3}[1-9]|[0-9]{2}[1-9][0-9]|[0-9][1-9][0-9]{2}|[1-9][0-9]{3})\b",
        ),
        (r"(?i)example|sample|placeholder|dummy|fake|test|mock|template|078[\-\s]05[\-\s]1120|123[\-\s]45[\-\s]6789|219[\-\s]09[\-\s]9999",),
        min_unique_chars=4,
    ),
    Group(
        "US Passport Number",
        (
            r"(?i)(?:passport|travel\s*doc(?:ument)?|pp\s*no|passport\s*(?:no|number|#))\s*[:\-]?\s*[0-9]{9}\b",
        ),
        (r"(?i)example|sample|placeholder|dummy|fake|test|mock|template|000000000|123456789",),
        min_unique_chars=3,
    ),
    Group(
        "ITIN (USA)",
        (
            r"\b9[0-9]{2}[\-\s](?:5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-2]|9[4-9])[\-\s][0-9]{4}\b",
        ),
        (r"(?i)example|sample|placeholder|dummy|fake|test|mock|template",),
        min_unique_chars=4,
    ),
    Group(
        "IBAN (Europe)",
        (
            r"\bDE[0-9]{2}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{2}\b",
            r"\bFR[0-9]{2}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9A-Z]{3}\b",
            r"\bGB[0-9]{2}[\s]?[A-Z]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{2}\b",
            r"\bES[0-9]{2}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}\b",
            r"\bIT[0-9]{2}[\s]?[A-Z][0-9]{3}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9A-Z]{3}\b",
            r"\bNL[0-9]{2}[\s]?[A-Z]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{2}\b",
            r"\bBE[0-9]{2}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}\b",
            r"\bAT[0-9]{2}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}\b",
            r"\bPT[0-9]{2}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{5}\b",
            r"\bIE[0-9]{2}[\s]?[A-Z]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}[\s]?[0-9]{2}\b",
        ),
        (r"(?i)example|sample|placeholder|dummy|fake|test|mock|template|GB29\s?NWBK|DE89\s?3704|FR76\s?3000",),
        min_unique_chars=4,
        validator="iban",
    ),
    Group(
        "UK National Insurance Number",
        (
            r"\b[A-CEGHJ-PR-TW-Z]{2}[\s\-]?[0-9]{2}[\s\-]?[0-9]{2}[\s\-]?[0-9]{2}[\s\-]?[A-D]\b",
        ),
        (r"(?i)example|sample|placeholder|dummy|fake|test|mock|template|AA\s?00\s?00\s?00\s?A",),
        min_unique_chars=4,
        validator="uk_nino",
    ),
    Group(
        "German Tax ID (Steuer-IdNr)",
        (
            r"(?i)(?:steuer[\-\s]?id(?:entifikationsnummer)?|tax[\-\s]?id|idnr|tin)\s*[:\-]?\s*[1-9][0-9]{10}\b",
        ),
        (r"(?i)example|sample|placeholder|dummy|fake|test|mock|template",),
        min_unique_chars=3,
    ),
    Group(
        "French NIR (Sécurité Sociale)",
        (
            r"\b[12][\s\-]?[0-9]{2}[\s\-]?(?:0[1-9]|1[0-2]|20)[\s\-]?[0-9]{2}[\s\-]?[0-9]{3}[\s\-]?[0-9]{3}[\s\-]?[0-9]{2}\b",
        ),
        (r"(?i)example|sample|placeholder|dummy|fake|test|mock|template",),
        min_unique_chars=4,
    ),
    Group(
        "Credit/Debit Card Number",
        (
            r"\b4[0-9]{3}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{1,4}\b",
            r"\b5[1-5][0-9]{2}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}\b",
            r"\b2(?:2[2-9][1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}\b",
            r"\b3[47][0-9]{2}[\s\-]?[0-9]{6}[\s\-]?[0-9]{5}\b",
            r"\b(?:6011|64[4-9][0-9]|65[0-9]{2})[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}\b",
            r"\b(?:60[0-9]{2}|65[0-9]{2}|81[0-9]{2}|82[0-9]{2})[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}\b",
            r"\b(?:5018|5020|5038|6304|6759|676[1-3])[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{0,7}\b",
        ),
        (r"(?i)example|sample|placeholder|dummy|fake|test|mock|template|4111[\s\-]?1111[\s\-]?1111[\s\-]?1111|5500[\s\-]?0000[\s\-]?0000[\s\-]?0004|3782[\s\-]?822463[\s\-]?10005|0000[\s\-]?0000",),
        min_unique_chars=4,
        validator="luhn",
    ),
)
