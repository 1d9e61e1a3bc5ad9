"""Which files must not leave: safety modes, sensitive files, the severity order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import paths

# Fixed values.
SENSITIVE_NAMES = [".env", ".env.local", ".env.development", ".env.production", ".env.test", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "credentials.json", "service-account.json", "service_account.json", "firebase-adminsdk.json"]
SENSITIVE_SUFFIXES = ["key", "pem", "p12", "pfx", "crt", "cer", "keystore", "jks"]
HIGH_RISK_NAMES = [".env", ".env.local", ".env.development", ".env.production", ".env.test", ".npmrc", ".pypirc", "credentials.json", "secrets.json", "secret.json", "service-account.json", "service_account.json", "firebase-adminsdk.json", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519"]
SAFE_SUFFIXES = ["key", "pem", "p12", "pfx", "crt", "cer", "keystore", "jks", "db", "sqlite", "sqlite3", "bak", "dump", "backup", "7z", "rar", "tar", "gz", "xz", "zip"]
BALANCED_SUFFIXES = ["key", "pem", "p12", "pfx", "crt", "cer", "keystore", "jks", "bak", "dump", "backup"]

_SKIP = "struct<reason:string,severity:string>"


def _skip(reason: Column | str, severity: str) -> Column:
    return F.struct((F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(severity).alias("severity"))


def safety(path: Column, mode: str) -> Column:
    """reason and severity of what keeps path out in mode (safe, balanced, full; others are safe), null if nothing does."""
    n, e = F.lower(paths.name(path)), paths.extension(path)
    example = n.endswith(".example") | n.endswith(".sample")
    high_risk = n.isin(HIGH_RISK_NAMES) | (n.startswith(".env") & ~example)
    if mode == "full":
        return F.lit(None).cast(_SKIP)
    first = F.when(high_risk, _skip("high-risk credential filename", "critical"))
    if mode == "balanced":
        return first.when(e.isin(BALANCED_SUFFIXES), _skip(F.concat(F.lit("credential/key suffix ."), e), "high"))
    secret = n.contains("secret") | n.contains("credential") | n.contains("private")
    return first.when(secret, _skip("secret-like filename", "high")).when(e.isin(SAFE_SUFFIXES), _skip(F.concat(F.lit("sensitive/binary suffix ."), e), "high"))


def sensitive_severity(path: Column) -> Column:
    """critical or high for files that are sensitive by name, null for others."""
    n, e = F.lower(paths.name(path)), paths.extension(path)
    example = n.endswith(".example") | n.endswith(".sample")
    env = n.startswith(".env") & ~example
    sensitive = n.isin(SENSITIVE_NAMES) | e.isin(SENSITIVE_SUFFIXES) | env
    return F.when(sensitive, F.when(n.startswith(".env") | e.isin("key", "pem", "p12", "pfx"), "critical").otherwise("high"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).when(severity == "low", 3).otherwise(9)
