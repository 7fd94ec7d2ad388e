"""Scoring kernels as column expressions (survey SIM1-SIM9).

score = coord * query_norm * sum over terms of tf * idf^2 * boost * norm * payload
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantise_norm(norm: Column) -> Column:
    """A norm as one byte would keep it: three bits of mantissa, rounded down."""
    power = F.pow(F.lit(2.0), F.floor(F.log2(norm) + F.lit(1e-12)))
    return F.when(norm > 0, power * F.floor(norm / power * 8 + F.lit(1e-12)) / 8).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Similarity:
    """idf: classic ln((N+1)/(df+1))+1, plain ln(N/(df+1))+1, or none. Flags switch the other factors off."""

    idf_kind: str = "classic"
    use_tf: bool = True
    use_norm: bool = True
    use_coord: bool = True
    use_query_norm: bool = True
    use_payload: bool = False
    quantised: bool = False

    def tf(self, freq: Column) -> Column:
        return F.sqrt(freq.cast("double")) if self.use_tf else F.when(freq > 0, F.lit(1.0)).otherwise(F.lit(0.0))

    def idf(self, df: Column, n_docs: int) -> Column:
        if self.idf_kind == "none":
            return F.lit(1.0)
        n = n_docs + 1 if self.idf_kind == "classic" else n_docs
        return F.log(F.lit(float(max(n, 1))) / (df.cast("double") + 1.0)) + 1.0

    def norm(self, length: Column) -> Column:
        if not self.use_norm:
            return F.lit(1.0)
        n = F.when(length > 0, 1.0 / F.sqrt(length.cast("double"))).otherwise(F.lit(0.0))
        return quantise_norm(n) if self.quantised else n

    def payload(self, payload: Column) -> Column:
        return F.coalesce(payload.cast("double"), F.lit(1.0)) if self.use_payload else F.lit(1.0)

    def coord(self, overlap: Column, terms: Column) -> Column:
        return overlap.cast("double") / terms if self.use_coord else F.lit(1.0)

    def query_norm(self, squares: Column) -> Column:
        return F.when(squares > 0, 1.0 / F.sqrt(squares)).otherwise(F.lit(1.0)) if self.use_query_norm else F.lit(1.0)

    def sloppy_freq(self, distance: Column) -> Column:
        return F.lit(1.0) if not self.use_query_norm else 1.0 / (distance.cast("double") + 1.0)


_BARE = {"use_norm": False, "use_coord": False, "use_query_norm": False}
CLASSIC = Similarity()
SIMILARITIES = {
    "default": Similarity("plain", quantised=True),
    "no_length_norm": Similarity("plain", use_norm=False),
    "no_length_norm_no_tf": Similarity("plain", use_tf=False, use_norm=False),
    "payload_idf": Similarity("plain", use_tf=False, use_payload=True, **_BARE),
    "payload_only": Similarity("none", use_tf=False, use_payload=True, **_BARE),
    "payload_aware": Similarity("classic", use_payload=True),
    "payload_aware_no_idf": Similarity("none", use_payload=True),
    "cosine": Similarity("none", **_BARE),
    "cosine_idf": Similarity("classic", **_BARE),
}
