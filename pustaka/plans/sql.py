"""SQL text shared by the twins: the same keys and tokens, written for DuckDB."""


def norm(c: str) -> str:
    lead = rf"regexp_replace(coalesce({c}, ''), '^\s*(?:Q(?:uestion)?\.?\s*)?\d{{1,3}}\s*[.):\-]*\s+', '', 'i')"
    return rf"trim(regexp_replace(lower(regexp_replace({lead}, '^\s*\(?[a-e]\)?[).:]\s+', '', 'i')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def q_key(c: str) -> str:
    lead = rf"regexp_replace(coalesce({c}, ''), '^\s*(?:Q(?:uestion)?\.?\s*)?\d{{1,3}}\s*[.):\-]*\s+', '', 'i')"
    x = rf"regexp_replace({lead}, '^\s*\(?[a-e]\)?[).:]\s+', '', 'i')"
    x = rf"regexp_replace({x}, '\s*\(\s*(?:answer\s+in\s+)?\d{{1,4}}\s*(?:words?|marks?)\s*\)\s*$', '', 'i')"
    x = rf"regexp_replace({x}, '\s*\(\s*\d{{1,3}}\s*\)\s*$', '')"
    return rf"substr(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), 1, 110)"


def name_key(c: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def base(c: str) -> str:
    return f"split_part(trim(coalesce({c}, '')), '#', 1)"


def host(c: str) -> str:
    return rf"regexp_replace(lower(regexp_extract(trim(coalesce({c}, '')), '(?i)^[a-z][a-z0-9+.\-]*://([^/?#:]*)', 1)), '^www\.', '')"


def slug(c: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'x')"


def paper(c: str) -> str:
    return f"CASE lower(trim(coalesce({c}, ''))) WHEN 'gs1' THEN 'GS1' WHEN 'gs2' THEN 'GS2' WHEN 'gs3' THEN 'GS3' WHEN 'gs4' THEN 'GS4' WHEN 'essay' THEN 'Essay' WHEN 'other' THEN 'Other' WHEN '' THEN 'Other' ELSE 'Optional' END"


def codes(c: str) -> str:
    return f"list_transform(string_split(coalesce({c}, ''), ''), lambda x: unicode(x)::BIGINT)"


def fnv32(c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') = '' THEN 2166136261 ELSE list_reduce({codes(c)}, lambda h, x: (xor(h, x) * 16777619) & 4294967295, 2166136261) END"


def djb32(c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') = '' THEN 5381 ELSE list_reduce({codes(c)}, lambda h, x: xor((h * 33) & 4294967295, x), 5381::BIGINT) END"


def meta(c: str, what: str) -> str:
    pattern = r"(?i)Word limit:\s*([^,]*)" if what == "words" else r"(?i)Marks:\s*(.*)$"
    x = rf"regexp_replace(trim(regexp_extract(coalesce({c}, ''), '{pattern}', 1)), '^[\[(]|[\])]$', '', 'g')"
    return rf"trim(regexp_replace({x}, '\s*(?:marks|words)\s*$', '', 'i'))"


def tokens(c: str) -> str:
    """Words for the index. RE2 has no look-ahead, so the letters of dotted abbreviations are marked in two steps."""
    x = rf"regexp_replace(lower(coalesce({c}, '')), '(^|[^\p{{L}}\p{{M}}\p{{N}}])\p{{L}}\.(\s)', '\1 \2', 'g')"
    for _ in range(6):
        x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{M}}\p{{N}}])\p{{L}}\.(\p{{L}}\.)', '\1 \2', 'g')"
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{M}}\p{{N}}]+')"
