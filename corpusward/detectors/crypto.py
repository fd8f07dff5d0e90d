"""Weak cryptography: pattern rules over source files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from corpusward.operators.regexscan import scan_all
from corpusward.schemas import Found, Tables, findings, language

ID = "insecure-crypto"
_SECURITY_WORD = r"\b(?:password|passwd|pwd|pw|secret|token|credential|auth|signature|signing|hmac|session)\b"
#: rule, severity, Python only, needs a security word near, pattern, title, why, what to do. Patterns are fixed values.
RULES = [
    ("crypto-md5-sha1", "high", False, True, r"(?i)createHash\s*\(\s*['\"](?:md5|sha1)['\"]\s*\)|\.createHash\s*\(\s*['\"](?:md5|sha1)['\"]", "MD5 or SHA-1 near security-relevant names", "Both are broken: collisions are cheap, and fast hashes don't protect passwords.", "Hash with SHA-256 or stronger; keep passwords with Argon2, bcrypt or scrypt."),
    ("crypto-create-cipher", "critical", False, False, r"createCipher\s*\(|createDecipher\s*\(", "Cipher without an explicit key and IV", "createCipher derives its key from the password with MD5 and no salt.", "Call createCipheriv with a random IV and a key from scrypt or PBKDF2."),
    ("crypto-math-random", "high", False, False, r"(?i)(?:token|secret|password|apiKey|api_key|session|nonce|otp)\s*[=:]\s*[^=\n]*Math\.random\s*\(", "Secret made with Math.random", "Math.random can be predicted from a few outputs.", "Take secrets from crypto.randomBytes or crypto.getRandomValues."),
    ("crypto-py-md5-sha1", "high", True, True, r"hashlib\.(?:md5|sha1)\s*\(", "Python MD5 or SHA-1 near security-relevant names", "Both are broken for passwords, tokens and signatures.", "Use hashlib.sha256 or stronger, or argon2 and bcrypt for passwords."),
    ("crypto-py-random", "high", True, False, r"(?i)(?:token|secret|password|api_key|session)\s*=\s*[^\n]*random\.(?:random|randint)", "Secret made with the random module", "The random module is predictable.", "Use the secrets module."),
]


def detect(tables: Tables) -> Found:
    files = tables.files.where("in_text_walk and issue_code is null").withColumn("lang", language(F.col("ext"))).where("lang is not null and text is not null")
    hits = scan_all(files, {r[0]: r[4] for r in RULES}, near="(?i)" + _SECURITY_WORD)
    told = lambda k: reduce(lambda w, r: w.when(F.col("rule") == r[0], F.lit(r[k])), RULES, F.when(F.lit(False), F.lit(RULES[0][k])))
    hits = hits.where(~told(2) | (F.col("lang") == "python")).where(~told(3) | F.col("near"))
    at = F.concat(F.col("path"), F.lit(":"), F.col("line"))
    made = findings(
        hits,
        id=F.concat_ws(":", F.lit(ID), F.col("rule"), at),
        detector_id=ID,
        severity=told(1),
        title=told(5),
        explanation=told(6),
        fix_prompt=F.concat(told(7), F.lit(" See "), at, F.lit(".")),
        file=F.col("path"),
        evidence=F.substring("match", 1, 80),
        metadata=F.to_json(F.struct(F.col("rule").alias("ruleId"))),
    )
    return Found(made, analysed=files.select("repo_id", "path"))
