"""Label cleaning: exact fixes, one ordered prefix, synonyms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Misspelt labels and their corrections.
FIXES = {
    "N内测副韧带": "N内侧副韧带",
    "N-内测半月板": "N内侧半月板",
    "内测半月板": "内侧半月板",
    "SPA-股二头肌建": "SPA-股二头肌腱",
    "GA股二头肌建": "GA股二头肌腱",
    "SPA-斌下肾囊炎": "SPA-髌下深囊炎",
    "滑膜那种": "滑膜囊肿",
}
# Names that mean the same once the prefix is gone.
SYNONYMS = {"髌骨前浅筋膜": "髌前浅筋膜"}
# Label prefixes and their classes; the first that fits counts.
PREFIXES = {
    "滑膜囊肿-": "滑膜囊肿",
    "损伤-": "损伤",
    "SPA-": "脊柱关节炎",
    "RA": "类风湿性关节炎",
    "OA": "骨性关节炎",
    "GA": "痛风性关节炎",
    "N": "正常",
}
SUSPICIOUS = ["滑膜那种"]
PATTERN = "^(" + "|".join(re.escape(p) for p in PREFIXES) + ")"


def mapped(label: Column, mapping: dict[str, str]) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, label), label)


def anatomy(label: Column) -> Column:
    """The label without its prefix."""
    return F.regexp_replace(label, PATTERN, "")


def disease(label: Column) -> Column:
    """The class that the prefix names, else null."""
    prefix = F.regexp_extract(label, PATTERN, 1)
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv)), prefix)


def fixed(label: Column) -> Column:
    """Trim, fix, strip the prefix, trim, synonym."""
    return mapped(F.trim(anatomy(mapped(F.trim(label), FIXES))), SYNONYMS)
