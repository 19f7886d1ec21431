"""Citations: section numbers, query variants by publisher, permanent links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_CODE
from .text import slugify, strip_affixes

# Abbreviations of codes in citations, by publisher, code or law.
STATES = {
    "fl-statutes": "Fla. Stat.", "nc-statutes": "N.C. Gen. Stat.", "va-statutes": "Va. Code Ann.", "wa-statutes": "Wash. Rev. Code", "oh-statutes": "Ohio Rev. Code",
    "ma-statutes": "Mass. Gen. Laws", "il-statutes": "735 Ill. Comp. Stat.", "pa-statutes": "Pa. Stat.", "nj-statutes": "N.J. Stat. Ann.", "ga-statutes": "Ga. Code Ann.",
    "co-statutes": "Colo. Rev. Stat.", "az-statutes": "Ariz. Rev. Stat.", "tn-statutes": "Tenn. Code Ann.",
}
TEXAS = {
    "agriculture": "Agric.", "alcoholic-beverage": "Alco. Bev.", "business-and-commerce": "Bus. & Com.", "business-organizations": "Bus. Orgs.", "civil-practice-and-remedies": "Civ. Prac. & Rem.",
    "education": "Educ.", "election": "Elec.", "estates": "Est.", "family": "Fam.", "finance": "Fin.", "government": "Gov't", "health-and-safety": "Health & Safety", "human-resources": "Hum. Res.",
    "insurance": "Ins.", "labor": "Lab.", "local-government": "Loc. Gov't", "natural-resources": "Nat. Res.", "occupations": "Occ.", "parks-and-wildlife": "Parks & Wild.", "penal": "Penal",
    "property": "Prop.", "special-district-local-laws": "Spec. Dist.", "tax": "Tax", "transportation": "Transp.", "utilities": "Util.", "water": "Water",
}
CALIFORNIA = {
    "BPC": "Bus. & Prof.", "CIV": "Civ.", "CCP": "Civ. Proc.", "COM": "Com.", "CONS": "Const.", "CORP": "Corp.", "EDC": "Educ.", "ELEC": "Elec.",
    "EVID": "Evid.", "FAM": "Fam.", "FIN": "Fin.", "FGC": "Fish & Game", "FAC": "Food & Agric.", "GOV": "Gov.", "HNC": "Harb. & Nav.", "HSC": "Health & Safety",
    "INS": "Ins.", "LAB": "Lab.", "MVC": "Mil. & Vet.", "PEN": "Pen.", "PROB": "Prob.", "PCC": "Pub. Contract", "PRC": "Pub. Res.", "PUC": "Pub. Util.",
    "RTC": "Rev. & Tax.", "SHC": "Sts. & High.", "UIC": "Unemp. Ins.", "VEH": "Veh.", "WAT": "Water", "WIC": "Welf. & Inst.",
}
CALIFORNIA_LONG = {
    "BPC": "Business and Professions", "CIV": "Civil", "CCP": "Code of Civil Procedure", "COM": "Commercial", "CORP": "Corporations", "EDC": "Education",
    "ELEC": "Elections", "EVID": "Evidence", "FAM": "Family", "FIN": "Financial", "FGC": "Fish and Game", "FAC": "Food and Agricultural",
    "GOV": "Government", "HNC": "Harbors and Navigation", "HSC": "Health and Safety", "INS": "Insurance", "LAB": "Labor", "MVC": "Military and Veterans",
    "PEN": "Penal", "PROB": "Probate", "PCC": "Public Contract", "PRC": "Public Resources", "PUC": "Public Utilities", "RTC": "Revenue and Taxation",
    "SHC": "Streets and Highways", "UIC": "Unemployment Insurance", "VEH": "Vehicle", "WAT": "Water", "WIC": "Welfare and Institutions",
}
NEW_YORK = {
    "ny-abandonment-of-property": "Aband. Prop.", "ny-agriculture-and-markets": "Agric. & Mkts.", "ny-alcoholic-beverage-control": "Alco. Bev. Ctrl.", "ny-alternative-county-government": "Alt. County Gov't",
    "ny-arts-and-cultural-affairs": "Arts & Cult. Aff.", "ny-banking": "Banking", "ny-benevolent-orders": "Benev. Orders", "ny-business-corporation": "Bus. Corp.",
    "ny-canal": "Canal", "ny-civil-practice-law-and-rules": "C.P.L.R.", "ny-civil-rights": "Civ. Rights", "ny-civil-service": "Civ. Serv.",
    "ny-cooperative-corporations": "Coop. Corp.", "ny-correction": "Correct.", "ny-county": "County", "ny-criminal-procedure": "Crim. Proc.",
    "ny-debtor-and-creditor": "Debt. & Cred.", "ny-domestic-relations": "Dom. Rel.", "ny-economic-development-law": "Econ. Dev.", "ny-education": "Educ.",
    "ny-election": "Elec.", "ny-eminent-domain-procedure": "Em. Dom. Proc.", "ny-energy": "Energy", "ny-environmental-conservation": "Envtl. Conserv.",
    "ny-estates-powers-and-trusts": "Est. Powers & Trusts", "ny-executive": "Exec.", "ny-family-court-act": "Fam. Ct. Act", "ny-financial-services": "Fin. Servs.",
    "ny-general-associations": "Gen. Assocs.", "ny-general-business": "Gen. Bus.", "ny-general-city": "Gen. City", "ny-general-construction": "Gen. Constr.",
    "ny-general-municipal": "Gen. Mun.", "ny-general-obligations": "Gen. Oblig.", "ny-highway": "High.", "ny-indian": "Indian",
    "ny-insurance": "Ins.", "ny-judiciary": "Jud.", "ny-labor": "Lab.", "ny-legislative": "Legis.",
    "ny-lien": "Lien", "ny-limited-liability-company": "Ltd. Liab. Co.", "ny-local-finance": "Loc. Fin.", "ny-mental-hygiene": "Mental Hyg.",
    "ny-military": "Mil.", "ny-multiple-dwelling": "Mult. Dwell.", "ny-multiple-residence": "Mult. Res.", "ny-municipal-home-rule": "Mun. Home Rule",
    "ny-navigation": "Nav.", "ny-not-for-profit-corporation": "Not-for-Profit Corp.", "ny-parks-recreation-and-historic-preservation": "Parks Rec. & Hist. Preserv.", "ny-partnership": "P'ship",
    "ny-penal": "Penal", "ny-personal-property": "Pers. Prop.", "ny-private-housing-finance": "Priv. Hous. Fin.", "ny-public-authorities": "Pub. Auth.",
    "ny-public-buildings": "Pub. Bldgs.", "ny-public-health": "Pub. Health", "ny-public-housing": "Pub. Hous.", "ny-public-lands": "Pub. Lands",
    "ny-public-officers": "Pub. Off.", "ny-public-service": "Pub. Serv.", "ny-racing-pari-mutuel-wagering-and-breeding": "Racing Pari-Mutuel", "ny-railroad": "R.R.",
    "ny-real-property": "Real Prop.", "ny-real-property-actions-and-proceedings": "Real Prop. Acts.", "ny-real-property-tax": "Real Prop. Tax", "ny-religious-corporations": "Relig. Corp.",
    "ny-retirement-and-social-security": "Retire. & Soc. Sec.", "ny-rural-electric-cooperative": "Rural Elec. Coop.", "ny-second-class-cities": "Second Class Cities", "ny-social-services": "Soc. Servs.",
    "ny-soil-and-water-conservation-districts": "Soil & Water Conserv. Dist.", "ny-state-administrative-procedure-act": "State Admin. Proc. Act", "ny-state-finance": "State Fin.", "ny-state-technology": "State Tech.",
    "ny-statute-of-local-governments": "Stat. Local Gov'ts", "ny-surrogate-s-court-procedure-act": "Sur. Ct. Proc. Act", "ny-tax": "Tax", "ny-town": "Town",
    "ny-transportation": "Transp.", "ny-transportation-corporations": "Transp. Corp.", "ny-uniform-commercial-code": "U.C.C.", "ny-vehicle-and-traffic": "Veh. & Traf.",
    "ny-village": "Village", "ny-volunteer-ambulance-workers-benefit": "Vol. Amb. Workers' Ben.", "ny-volunteer-firefighters-benefit": "Vol. Fire. Ben.", "ny-workers-compensation": "Workers' Comp.",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def section_number(path: Column, num: Column) -> Column:
    """Number of a section by its path's last segment, else by a contents entry's number; null if neither has one."""
    none = lambda c: F.nullif(c, F.lit(""))
    by_path = none(F.regexp_extract(F.substring_index(path, "/", -1), "^section-(.+)$", 1))
    named = none(F.trim(F.regexp_extract(num, r"(?i)(?:Section|§|Sec\.?)\s*(.+)", 1)))
    bare = F.when(F.trim(num).rlike(r"^[\d.]+$"), F.trim(num))
    return F.coalesce(by_path, named, bare)


def citation_variants(publisher: Column, jurisdiction: Column, source_id: Column, section: Column) -> Column:
    """The ways courts cite a section, as an array; empty without a section number or for municipal publishers."""
    title = F.nullif(F.regexp_extract(jurisdiction, r"title-(\d+)", 1), F.lit(""))
    forms = lambda *parts: F.array(*[F.concat(*[F.lit(p) if isinstance(p, str) else p for p in form], section) for form in parts])
    code = F.upper(source_id)
    short, full = _lookup(CALIFORNIA, code), _lookup(CALIFORNIA_LONG, code)
    texas = _lookup(TEXAS, F.regexp_extract(jurisdiction, "^[a-z]{2}-(.+)-code$", 1))
    out = (
        F.when(publisher == "usc", forms((title, " U.S.C. § "), (title, " USC § "), (title, " U.S.C. ")))
        .when(publisher == "ecfr", forms((title, " C.F.R. § "), (title, " CFR § ")))
        .when(publisher == "ca-leginfo", forms(("Cal. ", short, " Code § "), ("California ", short, " Code § "), (full, " Code section ")))
        .when(publisher == "ny-openleg", forms(("N.Y. ", _lookup(NEW_YORK, jurisdiction), " Law § ")))
        .when(publisher == "tx-statutes", F.coalesce(F.array_compact(forms(("Tex. ", texas, " Code § "))), F.array()))
        .otherwise(forms((_lookup(STATES, publisher), " § ")))
    )
    plain = F.array(F.concat(F.lit("Tex. § "), section))
    out = F.when((publisher == "tx-statutes") & texas.isNull(), plain).otherwise(out)
    return F.when(section.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(out))


def permalink(base: str, kind: Column, ident: Column, name: Column, state: Column, code: Column, path: Column) -> Column:
    """Public address of a jurisdiction, one of its codes (unless the default), or a section."""
    place = (
        F.when(kind == "federal", F.concat(F.lit("federal/"), F.regexp_replace(ident, "^us-", "")))
        .when(state.isNotNull(), F.concat(F.lower(state), F.lit("/"), slugify(strip_affixes(name))))
        .otherwise(ident)
    )
    return F.concat_ws("/", F.lit(base), place, F.when(code != DEFAULT_CODE, code), F.nullif(path, F.lit("")))
