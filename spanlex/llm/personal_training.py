"""Training of the personal-information model: labelled texts, maximum likelihood, export.

    python -m spanlex.llm.personal_training

Labelled texts come from a generator (bounded by ``TEXTS``): sentences that carry personal information,
sentences that carry what only looks like it, lists of people, references, tables and plain prose, in
mixed, lower and upper case and in several layouts.
"""

from __future__ import annotations

import json
import math
import random
from bisect import bisect_right
from collections import defaultdict
from pathlib import Path

from spanlex.llm.personal_data import MODEL, Context, Lexicon, Model, Span, all_features, candidates, islands

TEXTS, EPOCHS, RATE, DECAY, LEAST = 20000, 6, 0.25, 1e-4, 6

FILLER = (
    "the level of the serum was increased in most of 38 patients . in the first and in the second of the data the mean "
    "dose was 41.0 ( p 0.04 ) in the rats . it is of interest that the renal output was measured at 85 and at 56 hours , "
    "but the change was not seen . these findings suggest that the rate of the plasma is of importance . "
    "es wird über die drüse während der frühe leber berichtet . im verlauf der messung stieg sie auf 80 , während die "
    "säure unverändert blieb . nach der übertragung wurde eine schwäche gemessen , die für die leber spricht . die "
    "blutgefäße wurden bei den kranken gemessen und in der niere festgestellt . sie hatten gegessen und die dosis vergessen . "
    "les auteurs rapportent une cellule rénale après 172 jours de sécrétion . chez 154 sujets l'étude n'a pas été "
    "constatée . el estudio de la infección no ha observado cambios durante 266 años . la operación fue tratado en los "
    "enfermos con fiebre . a glass cylinder and the remainder of the bark made a landmark . the dose was a benchmark , no "
    "other remark was made in denmark . a reminder was sent to the other wards . results were read by a second observer . "
    "the consent was signed by all of the women . according to the analysis , the output was low . the box of the rotor "
    "was on the road . patients in the control row were kept at the place of the study . we thank all of the wards"
).split(" . ")

#: Held-out names of real languages. Training knows invented names only.
UNSEEN_GIVEN = (
    "Ravi Priya Chen Wei Yuki Hiroshi Fatima Omar Aisha Kwame Ngozi Sven Astrid Pablo Lucía Giovanni Chiara Dmitri Olga Pavel "
    "Siobhan Declan Rhys Mehmet Leyla Nguyen Linh Arjun Tomasz Agnieszka John Mary William Susan François Amélie Heinrich Grete"
).split()
UNSEEN_SURNAMES = (
    "Patel Sharma Zhang Liu Tanaka Sato Hussein Rahman Mensah Okafor Lindqvist Bergström García Fernández Rossi Bianchi Ivanov "
    "Petrova Novák O'Brien Murphy Davies Yilmaz Demir Tran Pham Gupta Kowalski Nowak Smith Johnson Brown Lefèvre Dubois Müller Schmidt"
).split()

#: Frequent endings of European surnames.
SURNAME_ENDINGS = (
    "son sen ssen man mann berg stein ski sky ska ov ova ev in ez es ic ton ley well ell land strand ford ault ard ier eau ini elli "
    "etti ano ström gren qvist dal by wick hurst worth field er ker s ing ington mark ler bach ett osk ek ak ík ane ey ay ham more ar"
).split()

WORDS = (
    "renal output serum plasma liver dose acute chronic blood cell tissue growth colon edema skin gland protein enzyme virus fever heart "
    "lung rat human study effect treatment level cancer tumor bone nerve muscle brain response analysis therapy infection rate acid "
    "leber niere wirkung gewebe messung cellule sujet sangre fiebre results methods summary conclusion introduction patients control"
).split()

A, Z = "\ue000", "\ue001"  # marks around what is labelled
CODES = {k: chr(0xE010 + i) for i, k in enumerate(("email", "phone", "id_number", "address", "name"))}


def tag(kind: str, text: str) -> str:
    return f"{A}{CODES[kind]}{text}{Z}"


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def syllables(self, low: int, high: int) -> str:
        """An invented word, seldom the same twice."""
        r = self.r
        one = lambda: r.choice(("", *"bcdfghjklmnprstvwyz", "ch", "sh", "tr", "br", "kr", "st", "th")) + r.choice("aaeeiiooué") + r.choice(("", "", "", *"nrlsmtkz"))
        word = "".join(one() for _ in range(r.randint(low, high)))
        return (word if len(word) > 2 else word + r.choice(("ng", "nn", "rr", "ra"))).capitalize()

    def given(self) -> str:
        return self.syllables(1, 3)

    def one(self) -> str:
        return self.syllables(1, 3) + (self.r.choice(SURNAME_ENDINGS) if self.r.random() < 0.6 else "")

    def place(self) -> str:
        return self.syllables(1, 3) + self.r.choice(("", "", "by", "ton", "field", "ham", "ford", "dale", "berg", "ville"))

    def host(self) -> str:
        r = self.r
        part = lambda: self.syllables(1, 3).lower() + r.choice(("", "", str(r.randint(1, 9))))
        return r.choice(("", "", "mail.", "lab.", "uni-")) + part() + r.choice(("", f"-{part()}")) + r.choice((".org", ".com", ".edu", ".test", ".example", ".invalid", ".example.org", ".net"))

    def surname(self) -> str:
        one = self.one
        s = one()
        if self.r.random() < 0.15:
            s += "-" + one()
        return self.r.choice(("van ", "de ", "el ", "von der ")) + s if self.r.random() < 0.12 else s

    def bare(self) -> str:
        return self.one()

    def initial(self) -> str:
        return self.r.choice("ABCDEFGHJKLMNPRSTV") + "."

    def name(self) -> str:
        k, given = self.r.random(), self.given()
        s = self.surname()
        if k < 0.45:
            n = f"{given} {s}"
        elif k < 0.6:
            n = f"{given} {self.initial()} {s}"
        elif k < 0.75:
            n = f"{self.initial()} {s}"
        elif k < 0.87:
            n = f"{self.initial()} {self.initial()} {s}"
        else:
            n = f"{self.bare()}, {self.r.choice((given, given, self.initial(), self.initial() + ' ' + self.initial(), given + ' ' + self.initial()))}"
        return tag("name", n)

    def full(self) -> str:
        return tag("name", f"{self.given()} {self.surname()}")

    def d(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def phone(self) -> str:
        r, a = self.r, self.r.randint(200, 999)
        last = f"{r.randint(0, 9999):04d}"
        mid = r.choice(("555", "555", self.d(3)))
        return tag("phone", r.choice((
            f"({a}) {mid}-{last}", f"{a}-{mid}-{last}", f"{a}.{mid}.{last}", f"+1 {a} {mid} {last}", f"1{a}{mid}{last}",
            f"+44 20 7946 {last}", f"+441632{self.d(6)}", f"01632 {self.d(6)}", f"01 99 00 {self.d(2)} {self.d(2)}",
            f"+49 (0)30 {self.d(5)} {self.d(3)}",
        )))

    def id(self) -> str:
        r = self.r
        ssn = r.choice((f"{r.choice(('666', self.d(3)))} {self.d(2)} {self.d(4)}", f"9{self.d(2)}-{self.d(2)}-{self.d(4)}"))
        label, number = r.choice((
            (r.choice(("SSN ", "SSN: ", "social security number ", "social security no. ")), ssn),
            (r.choice(("SSN ", "SSN: ", "social security number ", "social security no. ")), ssn),
            (r.choice(("national insurance no. ", "NI number ", "insured as ")), f"QQ {self.d(2)} {self.d(2)} {self.d(2)} {r.choice('ABCD')}"),
            (r.choice(("NHS no. ", "health service number ")), f"999 {self.d(3)} {self.d(4)}"),
            ("passport ", f"{r.choice('XZQ')}0{self.d(6)}"),
            (r.choice(("ID card ", "national identity number ")), f"{self.d(6)}-{self.d(4)}{r.choice('QXWZ')}"),
            (r.choice(("hospital record no. ", "MRN ", "chart number ")), f"0{self.d(6)}"),
        ))
        return label + tag("id_number", number)

    def street(self) -> str:
        r, p = self.r, self.place()
        kind = r.choice("Road Street Lane Drive Court Terrace Crescent Avenue Square Rd St. Ave Blvd".split())
        house = r.randint(1, 2400)
        k = r.random()
        if k < 0.34:
            t = f"{house} {r.choice(('', '', 'W. ', 'E. ', 'S. ', 'N. '))}{p} {kind}"
        elif k < 0.44:
            t = f"{house} {p} {kind.rstrip('.')}, Apt {r.randint(1, 30)}{r.choice('AB')}"
        elif k < 0.56:
            t = f"Flat {r.randint(1, 40)}, {house} {p} {kind}"
        elif k < 0.64:
            t = f"{house}-{house + 2} {p} Square"
        elif k < 0.78:
            t = f"{r.randint(1, 150)}{r.choice(('', 'b', 'bis', 'ter'))} rue {r.choice(('', 'de ', 'du '))}{p}"
        elif k < 0.84:
            t = f"{r.choice(('calle', 'Calle', 'via', 'Via', 'Plaza', 'Piazza', 'Rua', 'Avenida'))} {r.choice(('', '', 'de ', 'del '))}{p}{r.choice((' ', ', '))}{r.randint(1, 160)}"
        elif k < 0.92:
            t = f"{p}{r.choice(('weg', 'straße'))} {r.randint(1, 160)}"
        else:
            t = f"P.O. Box {r.randint(10, 2500)}"
        return tag("address", t)

    def email(self) -> str:
        r, s, g = self.r, self.one().lower(), self.given().lower()
        local = r.choice((f"{g}.{s}", f"{g[0]}{s}", f"{s}{r.randint(10, 99)}", f"{s}_{g[0]}", f"{g}+reprints", f"{s}-lab"))
        host = self.host()
        k = r.random()
        if k < 0.12:
            t = f"{local} {r.choice(('(at)', '[at]'))} {host.replace('.', r.choice((' (dot) ', '.')))}"
        elif k < 0.27:
            t = f"{local} @ {host}"
        elif k < 0.28:
            t = f"{local}@{host}".title()
        else:
            t = f"{local}@{host}"
        return tag("email", t)

    def carrier(self) -> str:
        r = self.r
        return r.choice((
            lambda: f"Written consent was signed by {self.name()}, the father of the second infant.",
            lambda: f"The slides were read by {self.name()} and by a second observer.",
            lambda: f"We thank {self.name()} for the sections and the photographs.",
            lambda: f"According to {self.name()} and {self.name()}, the dose was never exceeded.",
            lambda: f"The patient, {r.choice(('Mrs.', 'Mr.', 'Miss'))} {self.name()}, {self.id()}, was admitted at night.",
            lambda: f"One case ({self.id()}) was lost to follow-up.",
            *(lambda: f"{self.full()} ({self.id()}; home {self.phone()}) refused the biopsy.",) * 2,
            lambda: f"The widow of {self.name()} was reached by telephone ({self.phone()}).",
            lambda: f"Address reprint requests to Dr. {self.name()}, {self.street()}, {self.place()}.",
            lambda: f"All of the affected households lived near {self.street()} in {self.place()}.",
            lambda: f"Moved in the spring to {self.street()}; new contact {self.email()}.",
            lambda: f"Requests for the strain should be sent to {self.name()} <{self.email()}>.",
            lambda: f"Correspondence: {self.email()}.",
            lambda: f"tel/fax {self.phone()}; e-mail {self.email()}.",
            lambda: f"Emergency code break: {self.phone()}.",
            lambda: f"Further tables may be had by calling {self.phone()} {r.choice(('ext. 12', 'after noon', 'ext. 40'))}.",
            lambda: f"{self.name()}, {self.street()}, {self.place()}.",
            lambda: f"{self.full()}, {self.street()}, {self.phone()}.",
            lambda: f"{self.full()}, {self.id()}.",
            lambda: f"Next of kin: {self.name()}, {self.street()}, {self.phone()}.",
            lambda: f"{self.name()} {r.choice(('reviewed the slides', 'examined the sections', 'performed the autopsy', 'kept the records', 'read the films', 'refused', 'gave blood'))}.",
            lambda: f"{self.name()} and {self.name()} {r.choice(('reviewed the slides', 'were seen', 'counted the cells', 'agreed'))}.",
            lambda: f"{r.choice(('The sections were cut by', 'In a letter from', 'The sera came from', 'As was shown by', 'The records of', 'It was seen by', 'Dear', 'Thanks to'))} {self.name()}{r.choice((',', '.', ' in the spring.', ' at the hospital.'))}",
            lambda: f"{self.name()} {r.choice(('died', 'was seen', 'came', 'wrote'))} at {r.randint(20, 90)} years.",
            lambda: self.role(),
        ))()

    def role(self) -> str:
        """Persons behind titles, roles and prepositions of several languages."""
        r = self.r
        title = r.choice((
            "Patient", "Nurse", "nurse", "Captain", "Prof.", "Professor", "Herr", "Frau", "Señor", "Señora", "Mme", "Monsieur", "Madame", "Signora", "Signor",
            "Dr", "Dr.", "Mr", "Mrs", "Ms.",
        ))
        what = r.choice(("was admitted", "was discharged", "wrote the report", "came again", "agreed", "wurde aufgenommen", "a été admis", "fue ingresado", "called"))
        return r.choice((
            lambda: f"{title} {self.name()} {what}{r.choice(('.', ' in the spring.', f' by {title.lower()} {self.name()}.'))}",
            lambda: f"It was {r.choice(('reported', 'told', 'reviewed'))} by {self.name()} and {self.name()}.",
            lambda: f"{r.choice(('Kin', 'Reported by', 'Signed by', 'Dear'))} {self.name()}{r.choice(('', '.', ', ward 3', '; ' + self.name()))}",
            lambda: f"{r.choice(('Letter from', 'It was told by', 'Reported by', 'Photographs by'))} {self.name()} {r.choice(('the', 'wurde die', 'la'))} {self.term()} {what}.",
        ))()

    def lookalike(self) -> str:
        r = self.r
        return r.choice((
            lambda: f"Counts of {self.d(3)} {self.d(3)} {self.d(4)} per litre were not rare.",
            lambda: f"Lot {self.d(4)}-{self.d(4)}-{self.d(2)} of the antigen was used throughout.",
            lambda: f"Supported by grant no. {self.d(2)}-{self.d(3)}-{self.d(4)}.",
            lambda: f"Isotope activity fell from {self.d(3)}.{self.d(3)}.{self.d(4)} to background in {self.bare()} chambers.",
            lambda: (lambda s: f"The sign of {s} was absent and the {s} stain was negative.")(self.bare()),
            lambda: f"The {self.bare()}-{self.bare()} method was applied with {r.randint(2, 60)} street dogs.",
            lambda: f"Catalogue number K{self.d(7)} refers to the rotor.",
            lambda: f"Registered as trial CCT{self.d(8)} before the first dose.",
            lambda: f"See this journal, vol. {r.randint(1, 99)}, pp. {self.d(3)}-{self.d(4)}, {r.randint(1930, 1975)}.",
            lambda: f"The box of {r.randint(2, 99)} vials and flat {r.randint(2, 9)} mm dishes were stored on the road side of the ward.",
            lambda: f"It was given via {self.term()} {r.randint(2, 90)} {r.choice(('times', 'days', 'of the rats', 'mg'))}, and via the {self.term()} {r.randint(2, 9)} times.",
            lambda: f"Tubes were kept @ {r.randint(2, 42)} c for {r.randint(2, 40)} min.",
            lambda: f"{self.bare()} disease and the {self.bare()} test were seen at {self.place()}.",
            lambda: f"Stained with {self.bare()} dye and fixed by {self.bare()} acid.",
            *(lambda: self.capitals(),) * 6,
            *(lambda: self.behind_cue(),) * 3,
            lambda: f"The {self.bare()} syndrome was found in {self.d(2)} of {self.d(3)} cases.",
        ))()

    def behind_cue(self) -> str:
        """What stands behind a cue and is no person."""
        r, t = self.r, self.term
        thing = r.choice(("the series", "the experiment", "the method", "an observer", "the second observer", "means", "the addition", "many authors", "a nurse", "most", t(), f"{t()} {t()}", f"the {t()}"))
        cue = r.choice(("was reported by", "has been reported by", "were read by", "was examined by", "is reviewed by", "written by", "were cut by", "was told by", "were admitted by", "according to", "thanks to", "sent to", "requests to", "the widow of", "photographs by", "letter from"))
        return r.choice((
            f"The {t()} in the {t()} {cue} {thing} of the {t()}.", f"It {cue} {thing}, and the {t()} was {t()}.", f"{cue.capitalize()} {thing} in {self.d(2)} {t()}.",
            f"The {t()} of a nurse who had been {t()} with the {t()} of the frau was {t()}.",
        ))

    def term(self) -> str:
        """A technical word, mostly in no list."""
        r = self.r
        if r.random() < 0.4:
            return r.choice(WORDS)
        return (self.syllables(1, 4) + r.choice(("itis", "ine", "oma", "ase", "ic", "al", "oid", "otic", "osis", "ate", "pathy", "gram", "ous", "", ""))).lower()

    def prose(self) -> str:
        """Sentences and clauses of terms, any of which may begin a line."""
        r, t = self.r, self.term
        return " ".join(
            r.choice((
                lambda: f"{r.choice(('After', 'Before', 'Without', 'With', 'In', 'During'))} {r.choice(('it', t(), 'the ' + t()))}, the {t()} {t()} {r.choice(('was', 'of the', 'and the'))} {t()}, {t()} {t()}, and {t()} {t()} ({t()}).",
                lambda: f"The {t()} was {t()}, the {t()} {t()} was {t()}; {t()} {t()}: {self.d(2)}.",
                lambda: f"{t().capitalize()} {t()}, {t()} of the {t()}, and a {t()} {t()} were seen in {self.d(2)} {t()}.",
                lambda: f"{r.choice(('Según', 'Nach', 'Bei', 'Chez', 'Dans', 'Por', 'Con', 'Mit', 'Après'))} {r.choice(('estos', 'la', 'los', 'der', 'den', 'les', 'une', 'el'))} {t()}, {r.choice(('la', 'die', 'le', 'el'))} {t()} {r.choice(('fue', 'wurde', 'est', 'ha'))} {t()} {r.choice(('por', 'von', 'par', 'con'))} {r.choice(('la', 'der', 'les', 'un'))} {t()} ( {t()}, {self.d(2)} ).",
                lambda: f"There {t()} {r.choice('anp')} {t()} change, {t()} {r.choice('anp')}. {t()} was {t()}, as {t()} {t()}.",
            ))()
            for _ in range(r.randint(1, 3))
        )

    def listing(self) -> str:
        """Lines that begin with two terms and go on like a list of people."""
        r, t = self.r, self.term
        head = f"{t()} {t()}" if r.random() < 0.8 else f"{t()} {r.choice('abcdekp')} {t()}"
        tail = ", ".join(self.d(r.randint(1, 3)) for _ in range(r.randint(1, 6)))
        value, unit = r.choice(("-", "+", "++", "n.d.", self.d(3), f"{self.d(2)}.{self.d(1)}")), r.choice(("mg", "ml", "sec", "per cent", "mEq/l"))
        if r.random() < 0.3:
            return f"{head if r.random() < 0.6 else t()}: {value} {unit}"
        return r.choice((f"{head}, {tail}", f"{head}, {tail}", f"{head}: {self.d(2)}.{self.d(1)} mg", f"{head}, {t()}, {t()} {t()}", f"{head} ({self.d(2)}), {t()}", f"{head}; {t()}"))

    def capitals(self) -> str:
        """Capitalised runs that name no person."""
        r, t = self.r, self.term
        title = lambda: " ".join(self.term().capitalize() for _ in range(r.randint(2, 4)))
        return r.choice((
            lambda: f"{title()}.",
            lambda: f"{title()}\n{title()}: the {r.choice(WORDS)}.",
            lambda: f"The {title()} of {self.place()} was used.",
            lambda: f"{self.place()} {r.choice(('General Hospital', 'University', 'Medical School', 'Clinic', 'County'))} in {r.choice(('North', 'South', 'New', 'Upper'))} {self.place()}.",
            lambda: f"The {self.bare()} {r.choice(('Institute', 'Foundation', 'Hospital', 'Method', 'Test', 'Disease', 'Syndrome', 'Stain', 'Virus', 'Reflex', 'Sign'))} was named.",
            lambda: f"{self.bare()} {self.bare()} {r.choice(('disease', 'syndrome', 'test', 'stain', 'method', 'virus', 'reaction'))} was seen.",
            lambda: f"{r.choice(('Die', 'Der', 'Das', 'Eine', 'Nach', 'Bei', 'In', 'Les', 'Une', 'El', 'Los', 'Il'))} {r.choice((title(), t().capitalize()))} {r.choice(('von', 'der', 'wurde', 'de', 'de la'))} {r.choice(('gemessen', 'beobachtet'))}.",
            lambda: f"{r.choice(('In', 'Since', 'On', 'During'))} {r.choice(('January', 'March', 'June', 'October', 'Monday'))} {r.choice(WORDS).capitalize()} {r.choice(WORDS)} was low.",
            lambda: f"{r.choice(WORDS)} {r.choice(WORDS)}, {r.choice(WORDS)} {r.choice('ABCDEK')}, and vitamin {r.choice('ABCDEK')}. {r.choice(WORDS).capitalize()} {r.choice('np')}. {r.choice(WORDS)}.",
            lambda: f"{self.r.choice(('Hepatitis', 'Vitamin', 'Group', 'Type', 'Table', 'Figure', 'Class', 'Phase'))} {r.choice('ABCDE')} {r.choice(WORDS).capitalize()} was {r.choice(WORDS)}.",
        ))()

    def plain(self) -> str:
        r = self.r
        noun = r.choice("Gewebe Leber Größe Durchblutung Entzündung Niere Wirkung Drüse Säure Geschwulst Kranken Flüssigkeit".split())
        other = r.choice("Gewebe Leber Behandlung Übertragung Messung Schwäche Zuckergehalt".split())
        if r.random() < 0.25:
            return r.choice((
                f"Nach der {other} wurde eine plötzliche {noun} {r.choice(('gemessen', 'beobachtet', 'gelöst', 'vergessen'))}, die für die {other} spricht.",
                f"Die frühe {noun} wurde bei den {other} und in der Niere {r.choice(('gemessen', 'erhöht', 'vergessen'))}.",
                f"Bei {r.randint(2, 400)} Kranken war die {noun} der {other} nicht gemessen ({r.randint(2, 90)}.{self.d(3)}).",
                f"{r.choice(('Das', 'Die', 'Der', 'Ein', 'Dieses'))} {r.choice((noun, 'Verhältnis', 'Auftreten', 'Ergebnis', 'Vorkommen', 'Mittel'))} {r.choice(('von', 'der', 'zu', 'bei', 'aus'))} {self.term()} {r.choice(('zu', 'und', 'mit'))} {self.term()} war erhöht.",
                f"Es wird über die {noun} während der schwere {other} berichtet.",
            ))
        text = r.choice(FILLER)
        if r.random() < 0.5:  # what stands behind names stands behind other words, too
            words = text.split()
            for _ in range(r.randint(1, 2)):
                at = r.randint(1, len(words))
                words[at:at] = [r.choice((f"({self.term()}, {r.randint(2, 90)}.{self.d(3)})", f"({self.term()})", f", {self.d(2)} ,", ": ", f"; {self.term()}, {self.term()} ,", f"( {self.term()} , {self.d(2)} )"))]
            text = " ".join(words).replace(" , ", ", ").replace(" ,", ",") if r.random() < 0.7 else " ".join(words)
        text = text[:1].upper() + text[1:] + "."
        if r.random() < 0.25:
            text = r.choice((f"Im Verlauf der {noun} stieg die {other} an, ", f"Bei den {noun} war das {other} erhöht, ", f"Über die {noun} von {self.d(2)} Kranken: ")) + text
        return text

    def person_line(self) -> str:
        r = self.r
        end = r.choice((self.phone, self.street, self.email))()
        return f"{self.full()}, {r.choice(('ward', 'room', 'unit'))} {r.randint(1, 30)}, {end}"

    def reference(self) -> str:
        r = self.r
        who = tag("name", f"{self.bare()} {r.choice('ABCDEFGHIJKLMNOPRSTVW')}{r.choice(('', *'ABCDEFGHIJLMNPRSTVW'))}")
        return f"{who}: rapid {r.choice(('edema', 'colon', 'gland'))}. {r.choice(('acta', 'arch', 'bull', 'rev'))} renal {r.randint(1930, 1970)}; {r.randint(1, 99)}: {r.randint(1, 300)}-{r.randint(301, 900)}"

    def row(self) -> str:
        cell = lambda: self.r.choice(("-", "+", "n.d.", "n.d.", self.d(3), f"{self.r.random() * 99:.1f}", f"{self.r.random() * 9:.2f}±0.{self.d(2)}"))
        return self.r.choice(("  ", " ", "\t", " | ", ";", "           ")).join([self.term() if self.r.random() < 0.7 else f"{self.term()} {self.term()}", *(cell() for _ in range(5))])

    def noise(self) -> str:
        r = self.r
        return r.choice((
            lambda: f"{r.randrange(64) * 16:08x}  " + " ".join(f"{r.randrange(256):02x}" for _ in range(16)),
            lambda: "".join(r.choice("abcdefXYZ0123456789+/") for _ in range(60)),
            lambda: " ".join("".join(r.choice("ÃÂâï¿½œ™©°¬ž¢‚") for _ in range(r.randint(1, 4))) + self.term()[r.randint(0, 3) :] for _ in range(9)),
            lambda: " ".join(r.choice(("serum", "edema", "scar", self.d(3), self.d(2), "-", "++", "home")) for _ in range(9)),
            lambda: "serum edema, " + ", ".join(self.d(r.randint(1, 3)) for _ in range(r.randint(1, 6))),
        ))()

    def text(self) -> tuple[str, list[Span]]:
        r, k = self.r, self.r.random()
        if k < 0.1:
            raw = r.choice(("\n", "\r\n")).join(self.person_line() for _ in range(r.randint(3, 9)))
        elif k < 0.15:
            raw = "\n".join([*r.choice(([], [], ["see also"], ["references"], [f"{self.term()} of {self.term()}"])), *(self.reference() for _ in range(r.randint(1, 8)))])
        elif k < 0.33:
            line = r.choice((self.row, self.row, self.noise, self.noise, self.listing, self.listing))
            raw = "\n".join(line() for _ in range(r.randint(4, 10)))
        else:
            parts = []
            for _ in range(r.randint(2, 5)):
                x = r.random()
                parts.append(self.carrier() if x < 0.5 else self.lookalike() if x < 0.7 else self.prose() if x < 0.85 else self.plain())
            raw = r.choice((" ", "  ")).join(parts)
            if r.random() < 0.55:
                raw = self.wrap(raw)
        case = r.random()
        raw = "\ufeff" + raw if r.random() < 0.02 else raw
        raw = raw.lower() if case < 0.3 else raw.upper() if case < 0.42 else raw
        return read_marks(raw)

    def wrap(self, raw: str) -> str:
        width, lines, line = self.r.randint(45, 80), [], ""
        pad, joint = self.r.random() < 0.2, self.r.choice(("\n", "\r\n"))
        for w in raw.split(" "):
            if len(line) + len(w) + 1 > width:
                lines.append(line.ljust(width) if pad else line)
                line = ""
            line = f"{line} {w}" if line else w
        return joint.join([*lines, line])


def read_marks(raw: str) -> tuple[str, list[Span]]:
    """Text without marks, and the spans they enclose."""
    back = {v: k for k, v in CODES.items()}
    out, spans, start, kind, n = [], [], 0, "", 0
    for c in raw:
        if c == A:
            start = n
        elif c in back:
            kind = back[c]
        elif c == Z:
            spans.append(Span(start, n, kind))
        else:
            out.append(c)
            n += 1
    return "".join(out), spans


Island = tuple[list[Span], list[list[str]], list[int]]


def prepare(text: str, gold: list[Span], lexicon: Lexicon) -> tuple[list[Island], int]:
    """Islands with features and the places of right spans; how many right spans are no candidates."""
    right, out, hit, context = set(gold), [], 0, Context(text, lexicon)
    for group in islands(candidates(text, lexicon)):
        chosen = [i for i, s in enumerate(group) if s in right]
        hit += len(chosen)
        out.append((group, [all_features(s, context) for s in group], chosen))
    return out, len(right) - hit


def gradient(island: Island, weights: dict[str, float]) -> tuple[float, list[float]]:
    """Log-likelihood of the right division and, for each span, right minus expected."""
    spans, feats, chosen = island
    n = len(spans)
    score = [sum(weights.get(f, 0.0) for f in fs) for fs in feats]
    ends = [s.end for s in spans]
    before = [bisect_right(ends, s.start, 0, i) for i, s in enumerate(spans)]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    forward = [0.0]
    for i in range(n):
        forward.append(add(forward[i], forward[before[i]] + score[i]))
    # share of all divisions that go through each state and each span
    through = [0.0] * (n + 1)
    through[n] = 1.0
    expected = [0.0] * n
    for i in range(n - 1, -1, -1):
        p = math.exp(forward[before[i]] + score[i] - forward[i + 1])
        expected[i] = through[i + 1] * p
        through[before[i]] += expected[i]
        through[i] += through[i + 1] * (1 - p)
    right = set(chosen)
    return sum(score[i] for i in chosen) - forward[n], [(i in right) - expected[i] for i in range(n)]


def without_rare(data: list[Island], least: int = LEAST) -> list[Island]:
    """The same without features of fewer than ``least`` spans, which tell more of the invented words than of names."""
    counts: dict[str, int] = defaultdict(int)
    for _, feats, _ in data:
        for fs in feats:
            for f in fs:
                counts[f] += 1
    return [(spans, [[f for f in fs if counts[f] >= least] for fs in feats], chosen) for spans, feats, chosen in data]


def train(data: list[Island], epochs: int = EPOCHS, seed: int = 3) -> dict[str, float]:
    """Maximum likelihood by stochastic gradients with per-feature rates and decay of the weights."""
    r = random.Random(seed)
    weights: dict[str, float] = defaultdict(float)
    power: dict[str, float] = defaultdict(lambda: 1e-6)
    for epoch in range(epochs):
        r.shuffle(data)
        total = 0.0
        for island in data:
            ll, delta = gradient(island, weights)
            total += ll
            for fs, d in zip(island[1], delta):
                if abs(d) < 1e-4:
                    continue
                for f in fs:
                    g = d - DECAY * weights[f]
                    power[f] += g * g
                    weights[f] += RATE * g / math.sqrt(power[f])
        print(f"epoch {epoch}: log-likelihood {total / max(1, len(data)):.4f}", flush=True)
    return {f: round(w, 3) for f, w in weights.items() if abs(w) > 0.02}


class Unseen(Maker):
    """Texts all of whose persons have names of real languages, absent from training."""

    def given(self) -> str:
        return self.r.choice(UNSEEN_GIVEN)

    def one(self) -> str:
        return self.r.choice(UNSEEN_SURNAMES)


def measure(model: Model, seed: int, n: int, kind: type[Maker] = Maker) -> dict[str, dict[str, float]]:
    """Precision and recall of whole spans by kind on fresh texts."""
    maker, right, said, both = kind(seed), defaultdict(int), defaultdict(int), defaultdict(int)
    for _ in range(n):
        text, gold = maker.text()
        found = model.find(text)
        for s in gold:
            right[s.kind] += 1
        for s in found:
            said[s.kind] += 1
            both[s.kind] += s in gold
    return {k: {"precision": round(both[k] / max(1, said[k]), 4), "recall": round(both[k] / max(1, right[k]), 4)} for k in right}


def main() -> None:
    lexicon = Lexicon()
    maker, data, missed, all_gold = Maker(1), [], 0, 0
    for _ in range(TEXTS):
        text, gold = maker.text()
        ready, lost = prepare(text, gold, lexicon)
        data += ready
        missed += lost
        all_gold += len(gold)
    print(f"{len(data)} islands, {all_gold} spans, {missed} out of reach")
    weights = train(without_rare(data))
    report = measure(Model(weights, lexicon), 2, TEXTS // 5)
    unseen = measure(Model(weights, lexicon), 2, TEXTS // 5, Unseen)
    target = Path(__file__).parent / "models" / MODEL
    raw = {"held_out": report, "held_out_unseen_names": unseen, "weights": dict(sorted(weights.items()))}
    target.write_text(json.dumps(raw, ensure_ascii=False, indent=0) + "\n", encoding="utf-8")
    print(json.dumps({"held_out": report, "unseen names": unseen}, indent=1))


if __name__ == "__main__":
    main()
