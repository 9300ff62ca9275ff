"""Reference entities: countries and cities with the forms that denote them, as a dimension table."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Confidence of a match by the kind of form.
MATCH = {"exact": 1.0, "alias": 0.99, "transliteration": 0.97, "language_variant": 0.96, "historical": 0.90}
# Fixed values: (id, kind, parent, {kind of form: forms}); the first form is the name.
WORLD = (
    ("DZ", "country", None, {"exact": ["Algeria"], "alias": ["Algerie"], "language_variant": ["الجزائر"]}),
    ("MA", "country", None, {"exact": ["Morocco"], "alias": ["Maroc"], "language_variant": ["المغرب"]}),
    ("TN", "country", None, {"exact": ["Tunisia"], "alias": ["Tunisie"], "language_variant": ["تونس"]}),
    ("EG", "country", None, {"exact": ["Egypt"], "alias": ["Egypte"], "language_variant": ["مصر"]}),
    ("FR", "country", None, {"exact": ["France"], "language_variant": ["فرنسا"]}),
    ("DZ.ALG", "city", "DZ", {"exact": ["Algiers"], "transliteration": ["Alger"], "language_variant": ["الجزائر"]}),
    ("DZ.ORN", "city", "DZ", {"exact": ["Oran"], "language_variant": ["وهران"]}),
    ("DZ.CST", "city", "DZ", {"exact": ["Constantine"], "language_variant": ["قسنطينة"]}),
    ("DZ.ANB", "city", "DZ", {"exact": ["Annaba"], "historical": ["Bone"]}),
    ("DZ.SET", "city", "DZ", {"exact": ["Setif"]}),
    ("DZ.TLM", "city", "DZ", {"exact": ["Tlemcen"]}),
    ("MA.CAS", "city", "MA", {"exact": ["Casablanca"], "historical": ["Anfa"]}),
    ("MA.RAB", "city", "MA", {"exact": ["Rabat"]}),
    ("MA.FES", "city", "MA", {"exact": ["Fes"], "transliteration": ["Fez"]}),
    ("MA.MRK", "city", "MA", {"exact": ["Marrakech"], "transliteration": ["Marrakesh"]}),
    ("MA.TNG", "city", "MA", {"exact": ["Tangier"], "transliteration": ["Tanger", "Tangiers"]}),
    ("TN.TUN", "city", "TN", {"exact": ["Tunis"]}),
    ("TN.SFX", "city", "TN", {"exact": ["Sfax"]}),
    ("TN.SOU", "city", "TN", {"exact": ["Sousse"]}),
    ("TN.BIZ", "city", "TN", {"exact": ["Bizerte"], "transliteration": ["Bizerta"]}),
    ("EG.CAI", "city", "EG", {"exact": ["Cairo"], "transliteration": ["Al Qahirah"]}),
    ("EG.ALX", "city", "EG", {"exact": ["Alexandria"], "transliteration": ["Iskandariyah"]}),
    ("EG.GIZ", "city", "EG", {"exact": ["Giza"], "transliteration": ["Gizeh"]}),
    ("EG.MAN", "city", "EG", {"exact": ["Mansoura"], "transliteration": ["El Mansura"]}),
    ("FR.PAR", "city", "FR", {"exact": ["Paris"]}),
    ("FR.LYO", "city", "FR", {"exact": ["Lyon"], "transliteration": ["Lyons"]}),
    ("FR.MRS", "city", "FR", {"exact": ["Marseille"], "transliteration": ["Marseilles"]}),
    ("FR.LIL", "city", "FR", {"exact": ["Lille"]}),
    ("FR.TLS", "city", "FR", {"exact": ["Toulouse"]}),
)
CURRENCY = {"DZ": "DZD", "MA": "MAD", "TN": "TND", "EG": "EGP", "FR": "EUR"}


def fold(value: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return " ".join(bare.split()).casefold()


@dataclass(frozen=True)
class EntityPack:
    """Entities with unambiguous forms within a kind."""

    entities: tuple = WORLD

    def __post_init__(self) -> None:
        seen: dict[tuple[str, str], str] = {}
        for id_, kind, _, forms in self.entities:
            for f in (fold(x) for xs in forms.values() for x in xs):
                if seen.setdefault((kind, f), id_) != id_:
                    raise ValueError(f"{f!r} denotes both {seen[kind, f]} and {id_}")

    def table(self, spark: SparkSession, kind: str) -> DataFrame:
        """(form, id, parent, match, confidence): a few rows per entity, for a broadcast join on the folded text."""
        rows: dict[str, tuple] = {}
        for id_, k, parent, forms in self.entities:
            if k == kind:
                for match, texts in forms.items():
                    for t in texts:
                        rows.setdefault(fold(t), (fold(t), id_, parent, match, MATCH[match]))
        return spark.createDataFrame(list(rows.values()), "form string, id string, parent string, match string, confidence double")

    def resolve(self, value: object, kind: str) -> tuple[str | None, str, float]:
        """(id, match, confidence) of one text; ``unresolved`` if it is unknown."""
        if not isinstance(value, str) or not value.strip():
            return None, "unresolved", 0.0
        for id_, k, _, forms in self.entities:
            if k == kind:
                for match, texts in forms.items():
                    if fold(value) in {fold(t) for t in texts}:
                        return id_, match, MATCH[match]
        return None, "unresolved", 0.0
