"""Places: boroughs, grid cells, plate groups."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kerbstat.functions.text import upper_strip

# County codes of each borough.
BOROUGH_CODES = {
    "Manhattan": ["NY", "MAN", "MH", "MN", "NEWY", "NEW Y"],
    "Brooklyn": ["K", "BK", "KINGS"],
    "Queens": ["Q", "QN", "QNS", "QUEEN"],
    "Bronx": ["BX", "BRONX"],
    "Staten Island": ["R", "ST", "RICH"],
}

# Plate types that keep their own group.
COMMON_PLATE_TYPES = ["PAS", "COM", "OMT", "OMS", "SRF", "MED", "PHS"]

CELLS_PER_DEGREE = 200


def borough(county: Column) -> Column:
    """Borough of a county code, or Unknown."""
    pairs = [F.lit(v) for name, codes in BOROUGH_CODES.items() for code in codes for v in (code, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), upper_strip(county)), F.lit("Unknown"))


def plate_group(plate_type: Column) -> Column:
    """A common plate type as it is, anything else (null too) as OTHER."""
    return F.when(plate_type.isin(COMMON_PLATE_TYPES), plate_type).otherwise("OTHER")


def cell_edge(degrees: Column) -> Column:
    """Snap to the feature grid of 1/200 degree, halves to even."""
    return F.rint(degrees * CELLS_PER_DEGREE) / CELLS_PER_DEGREE


def cell_id(lat_edge: Column, lon_edge: Column) -> Column:
    """Name of a feature cell; null without a point."""
    text = F.concat_ws("_", lat_edge.cast("string"), lon_edge.cast("string"))
    return F.when(lat_edge.isNotNull() & lon_edge.isNotNull(), text)


def risk_grid(degrees: Column) -> Column:
    """Snap to the risk grid of three decimals, halves away from zero."""
    return F.round(degrees, 3)
