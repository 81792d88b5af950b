"""Oracle fragments shared by several queries."""

from tallyfold.fixed_values import MONTH_NAMES

NUMBER = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"


def plain(column: str) -> str:
    return (
        f"case when regexp_matches(trim({column}), {NUMBER}) then try_cast(trim({column}) as decimal(28,10)) end"
    )


def locale(column: str) -> str:
    return plain(f"replace({column}, ',', '.')")


def stamp(column: str) -> str:
    formats = ("%d-%m-%Y %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M")
    return "coalesce(" + ", ".join(f"try_strptime({column}, '{f}')" for f in formats) + ")"


def stamp_text(column: str) -> str:
    return f"strftime({stamp(column)}, '%Y-%m-%d %H:%M:%S')"


TYPED = (
    f"typed as (select src_row, file, line, service, reference, groupe, compagnie, pays, statut, devise_source, "
    f"{locale('montant')} as montant, {locale('a_percevoir')} as montant_a_percevoir, "
    f"{locale('commission')} as commission_partenaire from tx)"
)
TYPED_PLAIN = (
    f"typed as (select service, reference, groupe, compagnie, statut, {plain('montant')} as montant, "
    f"{plain('a_percevoir')} as montant_a_percevoir, {plain('commission')} as commission_partenaire from tx)"
)
VIEW = TYPED + (
    ", v as (select *, case when service like '%ENVOI%' then 'ENVOI' when service like '%PAIEMENT%' then 'PAIEMENT' end "
    "as type_operation, montant + commission_partenaire as montant_total from typed)"
)
MONTH_CASE = "case month_name " + " ".join(f"when '{m}' then {i}" for i, m in enumerate(MONTH_NAMES, 1)) + " end"


def total(value: str, where: str | None = None) -> str:
    clause = f" filter (where {where})" if where else ""
    return f"cast(coalesce(sum({value}){clause}, 0) as double)"
