"""Recognisers: what to look for, how sure a hit is, and which words around it count."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTEXT_WINDOW = 80
CONTEXT_BOOST = 0.15
MAX_BYTES = 50 * 1024 * 1024


@dataclass(frozen=True)
class Recogniser:
    """A pattern with its score; ``required`` keywords gate a hit, others raise its score."""

    name: str
    entity_type: str
    pattern: str
    score: float
    keywords: tuple[str, ...] = field(default=())
    required: bool = False

    def reachable(self, boost: float = CONTEXT_BOOST) -> float:
        return min(self.score + boost, 1.0) if self.keywords and not self.required else self.score


#: Name | entity type | score | keyword use | pattern | keywords.
BUILT_IN = r"""
email | EMAIL_ADDRESS | 0.9 | - | [\p{L}\p{N}._%+\-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,} | 
url | URL | 0.9 | - | https?://[^\s\)\]>"']+[^\s\)\]>"'.,;:!?] | 
intl_phone | PHONE_NUMBER | 0.6 | required | \+[1-9]\d{0,2}[\s.\-]?(?:\(\d{1,4}\)\s?)?(?:\d[\s.\-]?){6,14}\d | telephone, tel, phone, mobile, contact, call, number, appeler, numero, portable, whatsapp, sms, cell, fax
us_phone_paren | PHONE_NUMBER | 0.6 | required | \(\d{3}\)\s?\d{3}[\s.\-]\d{4}\b | telephone, tel, phone, mobile, contact, call, number, appeler, numero, portable, whatsapp, sms, cell, fax
uk_local_phone | PHONE_NUMBER | 0.5 | required | \b0\d{2,4}[\s.\-]\d{3,4}[\s.\-]\d{3,4}\b | telephone, tel, phone, mobile, contact, call, number, ring, whatsapp, sms, cell, fax
phone_extension | PHONE_EXTENSION | 0.85 | - | (?i)\b(?:poste|ext\.?|extension)\s+\d{3,5}\b | 
iban_generic | IBAN_CODE | 0.7 | required | \b[A-Z]{2}\d{2}[\s]?[\dA-Z]{4}(?:[\s]?[\dA-Z]{4}){2,7}(?:[\s]?[\dA-Z]{1,4})?\b | iban, compte, account, virement, bank, banque, bancaire, transfer, swift, bic, payment, paiement
ipv4 | IP_ADDRESS | 0.9 | - | \b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b | 
ipv6 | IP_ADDRESS | 0.9 | - | (?i)(?:\b[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}\b|::(?:ffff:)?(?:(?:25[0-5]|(?:2[0-4]|1?[0-9])?[0-9])\.){3}(?:25[0-5]|(?:2[0-4]|1?[0-9])?[0-9])|\b(?:[0-9a-f]{1,4}:){1,6}:[0-9a-f]{1,4}\b|\b(?:[0-9a-f]{1,4}:){1,5}(?::[0-9a-f]{1,4}){1,2}\b|\b(?:[0-9a-f]{1,4}:){1,4}(?::[0-9a-f]{1,4}){1,3}\b|\b(?:[0-9a-f]{1,4}:){1,3}(?::[0-9a-f]{1,4}){1,4}\b|\b(?:[0-9a-f]{1,4}:){1,2}(?::[0-9a-f]{1,4}){1,5}\b|\b[0-9a-f]{1,4}:(?::[0-9a-f]{1,4}){1,6}\b|::(?:[0-9a-f]{1,4}:){0,5}[0-9a-f]{1,4}\b|\b(?:[0-9a-f]{1,4}:){1,7}:) | 
date_iso8601 | DATE_TIME | 0.6 | - | \b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?\b | 
date_eu_slash | DATE_TIME | 0.5 | required | \b(?:0[1-9]|[12]\d|3[01])[/.](?:0[1-9]|1[0-2])[/.](?:19|20)\d{2}\b | date, naissance, birth, born, dob, expir, valid, depart, departure, arrive, arrival, le, du, au, issued, delivre, émis
date_written_fr | DATE_TIME | 0.8 | - | (?i)\b(?:0?[1-9]|[12]\d|3[01])(?:er)?\s+(?:janvier|février|fevrier|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre)\s+(?:19|20)\d{2}\b | 
date_written_en | DATE_TIME | 0.8 | - | (?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\.?\s+(?:0?[1-9]|[12]\d|3[01])(?:st|nd|rd|th)?,?\s+(?:19|20)\d{2}\b | 
mac_colon | MAC_ADDRESS | 0.85 | - | (?i)\b[0-9a-f]{2}(?::[0-9a-f]{2}){5}\b | 
mac_hyphen | MAC_ADDRESS | 0.85 | - | (?i)\b[0-9a-f]{2}(?:-[0-9a-f]{2}){5}\b | 
mac_cisco | MAC_ADDRESS | 0.85 | - | (?i)\b[0-9a-f]{4}\.[0-9a-f]{4}\.[0-9a-f]{4}\b | 
credit_card | CREDIT_CARD | 0.7 | required | \b(?:\d{4}[\s\-]?){3}\d{4}\b | card, credit, payment, cc, visa, mastercard, amex, cb, carte, bancaire, debit, paiement
uuid | UUID | 0.95 | - | \b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b | 
crypto_bitcoin | CRYPTO | 0.9 | - | \b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b | 
crypto_ethereum | CRYPTO | 0.9 | - | \b0x[0-9a-fA-F]{40}\b | 
job_title_role | JOB_TITLE | 0.7 | required | (?i)\b(?:(?:senior|junior|lead|head|chief|deputy|associate|executive|managing|principal|full[- ]stack|front[- ]end|back[- ]end|devops|crew|flight|ground|cabin|operations|commercial|hr|it|software|data|product|project|quality|safety|security|training|maintenance|aviation|business|technical)\s+)+(?:director|manager|developer|engineer|officer|planner|planning|specialist|coordinator|architect|consultant|administrator|supervisor|pilot|instructor|examiner|dispatcher|controller)\b | example-air, linkedin, mobile, tel, amelia, cordialement, cdlt
job_title_csuite | JOB_TITLE | 0.7 | required | \b(?:DSI|CIO|CEO|CFO|CTO|COO|CMO|CHRO|CPO|VP)\s*(?:/\s*(?:DSI|CIO|CEO|CFO|CTO|COO|CMO|CHRO|CPO|VP))*\b | example-air, linkedin, mobile, tel, amelia, cordialement, cdlt
fr_phone_intl | FR_PHONE_NUMBER | 0.9 | boost | \+33\s?[1-9](?:[\s.\-]?\d{2}){4} | telephone, tel, phone, mobile, contact, appeler, numero, portable
fr_phone_intl_0033 | FR_PHONE_NUMBER | 0.9 | boost | \b0033\s?[1-9](?:[\s.\-]?\d{2}){4} | telephone, tel, phone, mobile, contact, appeler, numero, portable
fr_phone_national | FR_PHONE_NUMBER | 0.7 | boost | \b0[1-9](?:[\s.\-]?\d{2}){4}\b | telephone, tel, phone, mobile, contact, appeler, numero, portable
fr_phone_compact | FR_PHONE_NUMBER | 0.6 | boost | \b0[1-9]\d{8}\b | telephone, tel, phone, mobile, contact, appeler, numero, portable
fr_iban | FR_IBAN | 0.95 | boost | \bFR\d{2}[ \t]\d{4}[ \t]\d{4}[ \t]\d{2}[A-Z0-9]{2}[ \t][A-Z0-9]{4}[ \t][A-Z0-9]{4}[ \t][A-Z0-9]\d{2}\b | iban, compte, account, virement, bank, banque, bancaire
fr_iban_compact | FR_IBAN | 0.9 | boost | \bFR\d{2}\d{5}\d{5}[A-Z0-9]{11}\d{2}\b | iban, compte, account, virement, bank, banque, bancaire
fr_ssn | FR_SSN | 0.85 | boost | [12]\s?\d{2}\s?(?:0[1-9]|1[0-2]|[2-9]\d)\s?(?:\d{2}|2[AB])\s?\d{3}\s?\d{3}(?:\s?\d{2})? | secu, securite sociale, ssn, nir, carte vitale, numero, immatriculation
fr_ssn_compact | FR_SSN | 0.8 | boost | [12]\d{2}(?:0[1-9]|1[0-2]|[2-9]\d)(?:\d{2}|2[AB])\d{6}(?:\d{2})? | secu, securite sociale, ssn, nir, carte vitale, numero, immatriculation
fr_passport | FR_PASSPORT | 0.7 | required | \b\d{2}[A-Z]{2}\d{5}\b | passeport, passport, document, identite, identité
aircraft_fr | AIRCRAFT_REGISTRATION | 0.95 | - | \bF-[A-Z]{4}\b | 
aircraft_eu | AIRCRAFT_REGISTRATION | 0.9 | - | \b(?:D|G|I|EC|HB|OO|PH|OE|SE|LN|OH|CS|EI|9H)-[A-Z]{3,4}\b | 
aircraft_us | AIRCRAFT_REGISTRATION | 0.85 | required | \bN[1-9][0-9]{0,4}[A-Z]{0,2}\b | aircraft, avion, registration, immat, appareil, tail, immatriculation
employee_matricule | EMPLOYEE_ID | 0.7 | required | \b[A-Z]{2,3}-\d{3,5}\b | matricule, employee, employé, employée, badge, agent, personnel, capitaine, copilote, pilote, commandant, officier
flight_amelia | FLIGHT_NUMBER | 0.9 | - | \b(?:IZM|RLA|AME|AML|GJT|AF)-?[0-9]{1,4}\b | 
flight_iata | FLIGHT_NUMBER | 0.4 | required | \b[A-Z]{2}-?[0-9]{1,4}\b | flight, vol, departure, arrival, schedule, rotation, leg, sector
flight_icao | FLIGHT_NUMBER | 0.5 | required | \b[A-Z]{3}-?[0-9]{1,4}\b | flight, vol, departure, arrival, schedule, rotation, leg, sector
crew_code | CREW_CODE | 0.85 | required | \b[A-Z]{3}\b | crew, equipage, équipage, pilot, pilote, captain, cdb, commandant, copilot, copilote, opl, cabin, pnc, pnt, steward, hostess, hôtesse, hotesse, first officer, fo, member, membre, roster, planning, duty, service, login
us_ssn_dash | US_SSN | 0.7 | required | \b\d{3}-\d{2}-\d{4}\b | ssn, social security, social, security number, tax
us_ssn_space | US_SSN | 0.65 | required | \b\d{3}\s\d{2}\s\d{4}\b | ssn, social security, social, security number, tax
medical_license | MEDICAL_LICENSE | 0.6 | required | \b[A-Z]{1,2}\d{6,10}\b | medical, license, licence, physician, doctor, dea, npi, practitioner, provider, prescriber
us_bank_number | US_BANK_NUMBER | 0.5 | required | \b\d{8,17}\b | account number, account, checking, savings, deposit, bank number, wire, ach, direct deposit
us_dl_alpha_short | US_DRIVER_LICENSE | 0.5 | required | \b[A-Z]\d{5,9}\b | driver, license, licence, dl, driving, dmv, permit, motor vehicle, state id
us_dl_alpha_long | US_DRIVER_LICENSE | 0.5 | required | \b[A-Z]\d{10,12}\b | driver, license, licence, dl, driving, dmv, permit, motor vehicle, state id
us_dl_alpha_pair | US_DRIVER_LICENSE | 0.5 | required | \b[A-Z]{2}\d{5,7}\b | driver, license, licence, dl, driving, dmv, permit, motor vehicle, state id
us_itin_dash | US_ITIN | 0.65 | required | \b9\d{2}-\d{2}-\d{4}\b | itin, taxpayer, tax id, tax identification, irs, individual taxpayer, tax
us_itin_space | US_ITIN | 0.6 | required | \b9\d{2}\s\d{2}\s\d{4}\b | itin, taxpayer, tax id, tax identification, irs, individual taxpayer, tax
us_passport | US_PASSPORT | 0.6 | required | \b\d{9}\b | passport, travel document, state department, passport number
us_mbi | US_MBI | 0.75 | required | \b[1-9][AC-HJKMNP-RT-Y][0-9AC-HJKMNP-RT-Y]\d[AC-HJKMNP-RT-Y][0-9AC-HJKMNP-RT-Y]\d{3}[AC-HJKMNP-RT-Y][0-9AC-HJKMNP-RT-Y]\b | medicare, mbi, beneficiary, cms, health insurance, medicaid
aba_routing | ABA_ROUTING | 0.7 | required | \b\d{9}\b | routing, aba, transit, routing number, wire, fedwire
uk_nhs_spaced | UK_NHS | 0.7 | required | \b\d{3}\s\d{3}\s\d{4}\b | nhs, nhs number, health, patient, national health, hospital, medical, gp, surgery
uk_nhs_compact | UK_NHS | 0.6 | required | \b\d{10}\b | nhs, nhs number, health, patient, national health, hospital, medical, gp, surgery
uk_nino_spaced | UK_NINO | 0.7 | required | \b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b | nino, national insurance, ni number, insurance number, tax, hmrc, paye, contributions
es_nif | ES_NIF | 0.7 | required | \b\d{8}[-\s]?[A-HJ-NP-TV-Z]\b | dni, nif, documento nacional, identificación, fiscal, documento, identidad
es_nie | ES_NIE | 0.7 | required | \b[XYZ][-\s]?\d{7}[-\s]?[A-HJ-NP-TV-Z]\b | nie, extranjero, identificación, residencia, foreigner
in_aadhaar_spaced | IN_AADHAAR | 0.7 | required | \b[2-9]\d{3}\s\d{4}\s\d{4}\b | aadhaar, aadhar, uid, uidai, unique identification, identity, biometric
in_aadhaar_compact | IN_AADHAAR | 0.6 | required | \b[2-9]\d{11}\b | aadhaar, aadhar, uid, uidai, unique identification, identity, biometric
in_pan | IN_PAN | 0.7 | required | \b[A-Z]{3}[CPHFATBLJG][A-Z]\d{4}[A-Z]\b | pan, permanent account, income tax, tax, pan card, pan number
in_vehicle_registration | IN_VEHICLE_REGISTRATION | 0.6 | required | \b[A-Z]{2}[-\s]?\d{2}[-\s]?[A-Z]{1,2}[-\s]?\d{1,4}\b | vehicle, registration, rto, car, number plate, license plate, motor
in_passport | IN_PASSPORT | 0.6 | required | \b[A-Z]\d{7}\b | passport, travel document, passport number, immigration, visa
in_voter | IN_VOTER | 0.6 | required | \b[A-Z]{3}\d{7}\b | voter, voter id, epic, election, electoral, electors, voter card
in_gstin | IN_GSTIN | 0.8 | required | \b\d{2}[A-Z]{3}[CPHFATBLJG][A-Z]\d{4}[A-Z]\d[Z][A-Z0-9]\b | gstin, gst, goods and services, tax identification, gst number
it_fiscal_code | IT_FISCAL_CODE | 0.85 | boost | \b[A-Z]{6}\d{2}[ABCDEHLMPRST]\d{2}[A-Z]\d{3}[A-Z]\b | codice fiscale, fiscal, cf, tax, contribuente, agenzia entrate, fiscale
it_driver_license | IT_DRIVER_LICENSE | 0.5 | required | \b[A-Z]{2}\d{7}[A-Z]\b | patente, guida, driver, license, driving, licence, patente di guida
it_vat_code | IT_VAT_CODE | 0.5 | required | \b\d{11}\b | partita iva, p.iva, piva, iva, vat, partita
it_passport | IT_PASSPORT | 0.5 | required | \b[A-Z]{2}\d{7}\b | passaporto, passport, travel document, documento viaggio
it_identity_card | IT_IDENTITY_CARD | 0.5 | required | \b[A-Z]{2}\d{5}[A-Z]{2}\b | carta d'identità, carta identità, carta identita, identity card, cie, documento, identità, identita
au_abn_formatted | AU_ABN | 0.7 | required | \b\d{2}\s\d{3}\s\d{3}\s\d{3}\b | abn, australian business number, business number, business, gst, tax, ato
au_abn_compact | AU_ABN | 0.6 | required | \b\d{11}\b | abn, australian business number, business number, business, gst, tax, ato
au_acn_formatted | AU_ACN | 0.7 | required | \b\d{3}\s\d{3}\s\d{3}\b | acn, australian company number, company number, company, asic, corporation
au_acn_compact | AU_ACN | 0.5 | required | \b\d{9}\b | acn, australian company number, company number, company, asic, corporation
au_tfn_formatted | AU_TFN | 0.7 | required | \b\d{3}\s\d{3}\s\d{3}\b | tfn, tax file number, tax file, tax number, tax, ato
au_tfn_compact | AU_TFN | 0.5 | required | \b\d{9}\b | tfn, tax file number, tax file, tax number, tax, ato
au_medicare_formatted | AU_MEDICARE | 0.7 | required | \b[2-6]\d{3}\s\d{5}\s\d\b | medicare, medicare number, medicare card, health card, health insurance
au_medicare_compact | AU_MEDICARE | 0.6 | required | \b[2-6]\d{9}\b | medicare, medicare number, medicare card, health card, health insurance
kr_rrn | KR_RRN | 0.7 | required | \b\d{6}-[1-4]\d{6}\b | rrn, resident registration, 주민등록, 주민번호, registration number, resident number, resident
kr_frn | KR_FRN | 0.7 | required | \b\d{6}-[5-8]\d{6}\b | frn, foreign registration, 외국인등록, alien registration, foreigner, registration number
kr_brn | KR_BRN | 0.7 | required | \b\d{3}-\d{2}-\d{5}\b | brn, business registration, 사업자등록, 사업자번호, business number, tax id, business
kr_driver_license | KR_DRIVER_LICENSE | 0.7 | required | \b(?:1[1-9]|2[0-8])-\d{2}-\d{6}-\d{2}\b | driver, license, licence, 운전면허, 면허번호, driving, dl
kr_passport | KR_PASSPORT | 0.6 | required | \b[MSROD]\d{8}\b | passport, 여권, 여권번호, travel document
sg_nric_fin | SG_NRIC_FIN | 0.7 | required | \b[STFGM]\d{7}[A-Z]\b | nric, fin, identity card, ic number, ic no, identification, singapore id, singapore
sg_uen_entity | SG_UEN | 0.7 | required | \b[RST]\d{2}[A-Z]{2}\d{4}[A-Z]\b | uen, unique entity, entity number, company, business, singapore, acra
sg_uen_company | SG_UEN | 0.6 | required | \b(?:19|20)\d{7}[A-Z]\b | uen, unique entity, entity number, company, business, singapore, acra
pl_pesel | PL_PESEL | 0.6 | required | \b\d{11}\b | pesel, nr pesel, numer pesel, identyfikator, polish id, identification number, national id, poland
si_emso | SI_EMSO | 0.6 | required | \b\d{13}\b | emso, emšo, matična številka, maticna stevilka, jmbg, personal id, identification number, slovenia
si_tax_number | SI_TAX_NUMBER | 0.6 | required | \b[1-9]\d{7}\b | davčna, davcna, davčna številka, davcna stevilka, tax number, tax id, ddv, slovenia
fi_personal_identity_code | FI_PERSONAL_IDENTITY_CODE | 0.6 | required | \b\d{6}[-+AYay]\d{3}[0-9A-Ya-y]\b | henkilötunnus, henkilotunnus, hetu, personal identity code, personal id, finnish id, identification number, finland, sosiaaliturvatunnus
th_tnin | TH_TNIN | 0.6 | required | \b\d{13}\b | thai, thailand, national id, identification number, citizen id, personal id, tnin, บัตรประชาชน, เลขบัตรประชาชน, เลขประจำตัว
"""

#: Credentials: vendor prefixes with least lengths, credentials in connection strings, assignments to names that say password or secret.
SECRETS = r"""
jwt | AUTH_TOKEN | 0.9 | - | \beyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,} |
openai_key | SECRET_KEY | 0.95 | - | \bsk-(?:proj-)?[A-Za-z0-9_-]{20,} |
github_token | SECRET_KEY | 0.95 | - | \bgh[pousr]_[A-Za-z0-9]{36,} |
github_fine_grained | SECRET_KEY | 0.95 | - | \bgithub_pat_[A-Za-z0-9_]{22,} |
aws_access_key | SECRET_KEY | 0.95 | - | \b(?:AKIA|ASIA)[A-Z0-9]{16}\b |
stripe_key | SECRET_KEY | 0.95 | - | \b[sr]k_(?:test|live)_[A-Za-z0-9]{16,} |
slack_token | SECRET_KEY | 0.95 | - | \bxox[abprs]-[A-Za-z0-9-]{10,} |
private_key | SECRET_KEY | 0.95 | - | -----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z]+ )*PRIVATE KEY----- |
connection_string | CONNECTION_STRING | 0.95 | - | \b[a-z][a-z0-9+.-]*://[^\s:/@"']+:[^\s@"']+@[^\s"'<>]+ |
assignment | PASSWORD | 0.8 | - | (?i)\b[a-z0-9_.-]*(?:password|passwd|pwd|secret|api_?token|auth_?token)[a-z0-9_-]*["']?\s*[:=]\s*(?:"[^"\n]{4,}"|'[^'\n]{4,}'|[^\s"',;]{4,}) |
"""

ENTITY_NAME = re.compile(r"[A-Z][A-Z0-9_]*")


def _parse(rows: str) -> list[Recogniser]:
    found = []
    for line in rows.strip().splitlines():
        name, entity, score, use, pattern, keywords = (x.strip(" ") for x in (line + " ").split(" | ", 5))
        found.append(Recogniser(name, entity, pattern, float(score), tuple(k for k in keywords.split(", ") if k), use == "required"))
    return found


def built_in() -> list[Recogniser]:
    return _parse(BUILT_IN) + _parse(SECRETS)


def from_yaml(text: str) -> list[Recogniser]:
    """Custom recognisers of a YAML document; anything malformed is an error."""
    import yaml

    found = []
    for entry in (yaml.safe_load(text) or {}).get("recognizers", []):
        if not ENTITY_NAME.fullmatch(entry["entity_type"]):
            raise ValueError(f"entity type {entry['entity_type']!r} isn't UPPER_SNAKE_CASE")
        for k, p in enumerate(entry["patterns"]):
            if not 0 <= float(p["score"]) <= 1:
                raise ValueError(f"score of {entry['name']} isn't in [0, 1]")
            if len(p["regex"]) > 1 << 20:
                raise ValueError(f"pattern of {entry['name']} is too large")
            import regex

            regex.compile(p["regex"])
            found.append(Recogniser(f"{entry['name']}_{k}" if k else entry["name"], entry["entity_type"], p["regex"], float(p["score"]), tuple(entry.get("context_keywords") or ()), bool(entry.get("context_required", False))))
    return found


def prune(recognisers: list[Recogniser], threshold: float, boost: float = CONTEXT_BOOST) -> list[Recogniser]:
    """Those that can reach the threshold at all."""
    return [r for r in recognisers if r.reachable(boost) >= threshold]


def catalogue(spark: SparkSession, recognisers: list[Recogniser] | None = None) -> DataFrame:
    """Entity types with the number of their patterns and how context acts on them."""
    rows = [(r.name, r.entity_type, r.score, list(r.keywords), r.required) for r in (recognisers if recognisers is not None else built_in())]
    df = spark.createDataFrame(rows, "name string, entity_type string, score double, keywords array<string>, required boolean")
    some = F.size("keywords") > 0
    return df.groupBy("entity_type").agg(F.count("*").alias("n_patterns"), F.max("score").alias("top_score"), F.bool_or(some & F.col("required")).alias("context_aware"), F.bool_or(some & ~F.col("required")).alias("context_boosted"))


__all__ = ["Recogniser", "built_in", "catalogue", "from_yaml", "prune", "replace"]
