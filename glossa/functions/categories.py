"""The tag taxonomy: fine types to coarse categories, and their checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.text import without_accents

#: Fine types by coarse category.
CATEGORIES = {
    "NAME": ("NOMBRE_SUJETO_ASISTENCIA", "NOMBRE_PERSONAL_SANITARIO"),
    "PROFESSION": ("PROFESION",),
    "LOCATION": ("HOSPITAL", "INSTITUCION", "CALLE", "TERRITORIO", "PAIS", "ID_CENTRO_DE_SALUD"),
    "AGE": ("EDAD_SUJETO_ASISTENCIA",),
    "DATE": ("FECHAS",),
    "CONTACT": ("NUMERO_TELEFONO", "NUMERO_FAX", "CORREO_ELECTRONICO", "URL_WEB"),
    "ID": ("ID_ASEGURAMIENTO", "ID_CONTACTO_ASISTENCIAL", "NUMERO_BENEF_PLAN_SALUD", "IDENTIF_VEHICULOS_NRSERIE_PLACAS", "IDENTIF_DISPOSITIVOS_NRSERIE", "IDENTIF_BIOMETRICOS", "ID_SUJETO_ASISTENCIA", "ID_TITULACION_PERSONAL_SANITARIO", "ID_EMPLEO_PERSONAL_SANITARIO", "OTRO_NUMERO_IDENTIF"),
    "OTHER": ("SEXO_SUJETO_ASISTENCIA", "FAMILIARES_SUJETO_ASISTENCIA", "OTROS_SUJETO_ASISTENCIA", "DIREC_PROT_INTERNET"),
}
#: The element names that official scoring reads.
ELEMENTS = ("PHI", "NAME", "PROFESSION", "LOCATION", "AGE", "DATE", "CONTACT", "ID", "OTHER")
#: Entity types of column corpora.
ENTITY_TYPES = ("PER", "LOC", "ORG", "MISC")


def category_of(tag: Column, categories: dict[str, tuple[str, ...]] = CATEGORIES) -> Column:
    """The coarse category of a fine type as it is, else without accents, else WARNING.  A literal map: no join."""
    pairs = F.create_map(*(F.lit(x) for c, types in categories.items() for t in types for x in (t, c)))
    return F.coalesce(pairs[tag], pairs[without_accents(tag)], F.lit("WARNING"))


def entity_type_of(tag: Column, types: tuple[str, ...] = ENTITY_TYPES, other: str = "OTROS") -> Column:
    return F.when(tag.isin(*types), tag).otherwise(F.lit(other))


def valid_span(category: Column, kind: Column, start: Column, end: Column, categories: dict[str, tuple[str, ...]] = CATEGORIES) -> Column:
    """Whole-number offsets, and a type of its category: a mark, never a filter."""
    from glossa.functions.text import is_int

    known = F.lit(False)
    for c, types in categories.items():
        known = known | ((category == c) & kind.isin(*types))
    return F.coalesce(is_int(start) & is_int(end) & known, F.lit(False))
