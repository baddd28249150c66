"""The small labelled table from which the sequence model for personal data is trained.

Each line is a text with its personal data marked as [type|datum]; {slots} stand for the values
below, so that one line gives several examples. Everything is invented.
"""

from __future__ import annotations

import random
import re

SLOTS: dict[str, list[str]] = {
    "n": [
        "Anna Berger", "Peter O'Neill", "Marta Kowalska", "BERGER, Anna", "J. Ashdown", "Luis Ferrer", "Zoë Hartwell", "HANNAH ASHDOWN", "Ferrer, Luis", "T. Kowalski", "Jürgen Brandt", "José Almeida", "Inés Pardo", "Oskar Lindqvist",
        "Ashdown", "Renée Dumas", "Björn Sandell", "MARCO RINALDI", "Łucja Zalewska", "R. Dumas", "Sørensen, Mette", "Philippa Thorne", "Simon R. Coles", "Nadia Benali", "ÉMILE ROUSSEL", "Tomás Vidal", "RÖDL, Karin", "Vidalström", "Agnès Tellier", "Victor Norrgard", "Helen Quistberry", "Felix Branmere", "Holmgard", "Tarnquist", "Belhurst", "Kesmask", "Pérlow", "Wenvini", "D. Holmgard", "TARNQUIST, Ruth", "Clara B. Wenvini", "MARWICK", "Norlindor", "Ulstadt", "Daniel Oskova", "Vera T. Pelham", "Paul G. Gorham", "M. Oskhurst", "Irene Belmar", "Judith B. Tolmie", "Chloé Kessel", "AgnÃ¨s Norwin", "JÃœRGEN LOMAN", "Tom├í┼í Varga", "Leon PÃ©rÃ¡n", "Lena Marán",
    ],
    "e": ["anna.berger@mail.test", "LUIS+HR@CORP.EXAMPLE", "ferrer_luis@example.org", "jashdown [at] post.test", "marco.rinaldi(at)example(dot)com", "zhartwell @ example.net", "karin-roedl AT example DOT org", "brandt42@intra.invalid", "t.vidal＠team.example.com", "renee.dumas@sub.example.net", "thorne77 (at) mail (dot) example"],
    "p": [
        "(212) 555-0147", "212-555-0147", "212.555.0147", "2125550147", "+1 212 555 0147", "1-212-555-0147", "+44 7700 900123", "+44 (0)1632 960 123", "01632 960123", "+49 30 23125 147", "030/23125147", "+33 1 99 00 12 34", "0033 199 001234", "(0)1632 960123", "+1 (212) 555-0147", "+34 600 555 123", "01 99 00 12 34", "0049 30 23125147", "(030) 23125147",
    ],
    "s": ["912-34-5678", "912 34 5678", "912345678", "912–34–5678"],
    "x": ["X12345678", "Z123 4567", "X123 4567", "C01234567"],
    "b": ["DE36 1314 0000 3334 6798 75", "GB25TEST95467314824522", "FR2100002000036766083387536", "GB74 TEST 7720 1975 6430 77", "DE12131400003630780276", "FR26 0000 2000 0873 0205 7123 372"],
    "c": ["9999 0098 7935 1463", "9999-0007-8934-4789", "9999004502264746", "4000 1234 5678 9010"],
    "q": ["QQ 12 34 56 A", "QQ123456B", "QQ 123456 C"],
    "ln": ["Ashdown", "Vidalström", "Holmgard", "Tarnquist", "Belhurst", "Kesmask", "Pérlow", "Wenvini", "Norlindor", "Ulstadt", "Oskova", "Gormere", "Linbourne", "Ravkova", "Selthorn", "Munwick", "Yarlow", "Pellström", "Grüdale", "Zelovan"],
    "a": [
        "12 Mill Lane", "754 Upper Ridge St #12", "66 Alderwood Street, 2nd Floor", "P.O. Box 81", "PO Box 1044", "869A St. Edmund Road", "91 Cooper's Close, Suite 300", "53C Harbour Ave, Apt 4B", "5 Fifth Drive", "111 Tansy Ln.", "605 Old Orchard Way", "45 Long Field Terrace", "973 Third Ave", "18b Quarry Rd.", "230 Elm Court", "7 Castle Hill Crescent", "64 Station Blvd", "9 Park Square",
    ],
    "ade": ["Lindenallee 17", "Obere Straße 160a", "Mühlenstr. 5", "Am Alten Markt 12", "Feldgasse 72a", "Neue Gasse 3", "Hauptstraße 44", "Bahnhofsplatz 1", "Lange Weg 9", "Birkenfelder Gasse 173", "Untere Straße 18"],
    "afr": ["139, bd de la Grève", "42, rue des Aubépines", "85 bis, impasse Tourlac", "27, avenue du Vieux-Moulin", "3, place du Marché", "14 rue Neuve", "6 ter, chemin des Dames", "72, quai du Port"],
    "aes": ["Calle Marina, 25", "C/ de la Cañada, 17", "Avda. del Olmo, 53", "Plaza del Olmo Viejo, 165", "Paseo Nuevo, 8", "Avenida Sur 140", "Camino Real, 77", "Calle Mayor 3"],
    "co": ["Orlen & Sons", "Hartfield Logistics", "Quintero Holdings", "Brightwell Ltd", "Calder GmbH", "Rossmere S.A.", "Novahaven Media Group", "Pell Office Supply", "Dunmore Instruments", "Ilverton Partners", "Kesterby Foods", "Ostrow-Linden Textiles", "Tessal Packaging"],
    "ci": ["Larkham", "Port Elham", "Saint-Oriel", "Graustadt", "Kestrel Bay", "Westmoor", "Tarn Dale", "Villanova", "Osterdorf", "Harrowfield"],
    "j": ["Chief Financial Officer", "Plant Manager", "Notary", "Witness", "Authorised Agent", "Director of Sales", "Procurement Lead"],
    "d": ["People", "Legal", "Sales", "Operations", "Finance", "Logistics", "Engineering", "Marketing", "Research"],
    "t": ["Mr", "Mrs", "Ms", "Dr", "Dr.", "Prof.", "Mr.", "Ms.", "Mrs.", "Prof"],
    "num": ["2,092.31", "556.00", "17", "4321", "1,204", "82", "968.20"],
    "w": ["invoice", "delivery note", "report", "survey", "contract", "coupon"],
}

LINES = """
Dear {t} [name|{ln}],
{t} [name|{ln}] signed the receipt at the gate.
[name|{ln}] signed the receipt at the gate.
The form was handed to {t} [name|{ln}] on arrival.
according to {t} [name|{ln}], the parcel was open
Prepared by {t} [name|{ln}] for the file.
Contact: {t} [name|{ln}]
Contact: [name|{ln}]
Witness: {t} [name|{ln}]
Ansprechpartner: {t} [name|{ln}]
Die Unterlagen wurden von {t} [name|{ln}] abgeholt.
Le dossier a été remis à {t} [name|{ln}] hier.
Firmado por {t} [name|{ln}]
Atención: {t} [name|{ln}]
Dear [name|{n}],
Dear {t} [name|{n}], thank you for the {w}.
Contact: [name|{n}]
Contact: {t} [name|{n}]
Contact person: [name|{n}]
Witness: [name|{n}]
Signed: [name|{n}]
Signed by {t} [name|{n}]
[name|{n}] signed the receipt at the gate.
{t} [name|{n}] signed the receipt at the gate.
The form was handed to [name|{n}] on arrival.
The form was handed to {t} [name|{n}] on arrival.
according to [name|{n}], the parcel was open
according to {t} [name|{n}], the parcel was open
Prepared by [name|{n}] for the file.
Prepared by {t} [name|{n}] for the file.
Yours sincerely, [name|{n}]
Attn: [name|{n}]
Atención: [name|{n}]
À l’attention de [name|{n}]
z. Hd. [name|{n}]
Ship to:
Dear [name|{n}], [name|{n}] signed the receipt at the gate.
Name: [name|{n}]
Ansprechpartner: [name|{n}]
Die Unterlagen wurden von [name|{n}] abgeholt.
Die Unterlagen wurden von {t} [name|{n}] abgeholt.
Sehr geehrte Frau [name|{n}],
Sehr geehrter Herr [name|{n}], die Rechnung liegt bei.
Unterzeichnet von Herrn [name|{n}]
Le dossier a été remis à [name|{n}] hier.
Le dossier a été remis à {t} [name|{n}] hier.
Signé par [name|{n}]
Madame [name|{n}], Monsieur [name|{n}],
Firmado por [name|{n}]
Firmado por {t} [name|{n}]
Estimado Sr. [name|{n}]:
A carta foi entregue a [name|{n}] ontem.
Contact: [name|{n}] Dear [name|{n}], Ansprechpartner: [name|{n}]
Firmado por [name|{n}] Dear [name|{n}],
[name|{n}]
[name|{n}], {co}
[email|{e}]
[email|{e}]
[email|{e}]
[email|{e}]
[email|{e}]
[phone|{p}]
[address|{a}]
[address|{a}], {ci}
[name|{n}]
Home address: [address|{a}]
Home address: [address|{a}]
Vive en [address|{aes}]
Lieferadresse: [address|{ade}], {ci}
Lieferadresse: [address|{ade}], {ci}
Sie wohnt jetzt [address|{ade}] in {ci}
Dear [name|{n}],
Contact: [name|{n}]
[name|{n}] signed the receipt at the gate.
Prepared by [name|{n}] for the file.
Email: [email|{e}]
E-mail: [email|{e}]
E-Mail: [email|{e}]
Correo: [email|{e}]
Courriel : [email|{e}]
To: <[email|{e}]>
cc: [email|{e}]
Reply-To: <[email|{e}]>
Questions go to [email|{e}] before Friday.
Please write to [email|{e}] or call the desk.
She confirmed by mail ([email|{e}]).
Rückfragen bitte an [email|{e}] senden.
Pour toute question, écrire à [email|{e}] avant lundi.
Escriba a [email|{e}] si necesita ayuda.
Tel. [phone|{p}]
Tel.: [phone|{p}]
Tél. : [phone|{p}]
Phone: [phone|{p}]
Mobile: [phone|{p}]
Mob. [phone|{p}]
Telefon: [phone|{p}]
Teléfono: [phone|{p}]
Call [phone|{p}] after nine.
Fax/phone [phone|{p}].
ring me on [phone|{p}], thanks
You may also reach the driver at [phone|{p}] until noon.
Sie erreichen uns unter [phone|{p}] ab acht Uhr.
Joignable au [phone|{p}] le matin.
Llame al [phone|{p}] por la tarde.
Fax: [phone|{p}]
Contact: [name|{n}] [phone|{p}]
SSN: [id_number|{s}]
SSN [id_number|{s}]
The SSN on file is [id_number|{s}].
Social security no.: [id_number|{s}]
Social security no. [id_number|{s}]
soc. sec. number: [id_number|{s}]
soc. sec. number [id_number|{s}]
Taxpayer ID: [id_number|{s}]
Taxpayer ID [id_number|{s}]
The Taxpayer ID on file is [id_number|{s}].
Holder's SSN ([id_number|{s}]) was checked at the counter.
Holder's soc. sec. number ([id_number|{s}]) was checked at the counter.
Holder's Social security no. ([id_number|{s}]) was checked at the counter.
Holder's Taxpayer ID ([id_number|{s}]) was checked at the counter.
The soc. sec. number on file is [id_number|{s}].
The Social security no. on file is [id_number|{s}].
NINO: [id_number|{q}]
NINO [id_number|{q}]
The NINO on file is [id_number|{q}].
NI number: [id_number|{q}]
NI number [id_number|{q}]
National Insurance no.: [id_number|{q}]
National Insurance no. [id_number|{q}]
Holder's National Insurance no. ([id_number|{q}]) was checked at the counter.
Holder's NINO ([id_number|{q}]) was checked at the counter.
The National Insurance no. on file is [id_number|{q}].
Passport: [id_number|{x}]
Passport no.: [id_number|{x}]
Passport no. [id_number|{x}]
Passport [id_number|{x}]
Travel document: [id_number|{x}]
Travel document [id_number|{x}]
The Passport on file is [id_number|{x}].
The Passport no. on file is [id_number|{x}].
Holder's Passport ([id_number|{x}]) was checked at the counter.
Holder's Passport no. ([id_number|{x}]) was checked at the counter.
IBAN: [id_number|{b}]
IBAN [id_number|{b}]
The IBAN on file is [id_number|{b}].
Bank account: [id_number|{b}]
Bank account [id_number|{b}]
Payable to account: [id_number|{b}]
Payable to account [id_number|{b}]
Holder's IBAN ([id_number|{b}]) was checked at the counter.
Holder's Payable to account ([id_number|{b}]) was checked at the counter.
The Bank account on file is [id_number|{b}].
Card [id_number|{c}]
Card: [id_number|{c}]
Card number: [id_number|{c}]
Credit card no.: [id_number|{c}]
Credit card no. [id_number|{c}]
Paid by card: [id_number|{c}]
Paid by card [id_number|{c}]
The Credit card no. on file is [id_number|{c}].
Holder's Card ([id_number|{c}]) was checked at the counter.
[address|{a}]
[address|{a}], {ci}
Deliver to [address|{a}], {ci} by noon.
Deliver to [address|{a}] by noon.
The applicant lives at [address|{a}] in {ci}.
moved from [address|{a}] to {ci} last year
Home address: [address|{a}], {ci}
Address: [address|{a}], {ci}
Lieferadresse: [address|{ade}], {ci}
Sie wohnt jetzt [address|{ade}] in {ci}.
Er wohnt in der [address|{ade}] in {ci}.
Adresse : [address|{afr}], {ci}
Il habite [address|{afr}] à {ci}.
Domicilio: [address|{aes}], {ci}
Vive en [address|{aes}] de {ci}.
[name|{n}], [address|{a}], {ci}, [phone|{p}]
Order no. 764-25-6041 was split.
Order no. 119 65 8628 was split.
Tracking number 94630973097946331Z is inactive.
Firmware 10.14.14.14 is current.
Price: 22 pcs @ 968.00 each.
Account class 82-754, cost centre 9473.
Container TGHU 8454614 arrived with 8454 kg.
Meeting room @56, second floor.
Follow #8723 and @town_news on the board.
ISBN 978-0-547-88321-1 is out of print.
Coupon code 4573-4573-4573 expires soon.
Lot 713 3734 713 passed with code QX373490.
Part 339.339.1514 fits model 18-1514.
Invoice INV-3254-43768 replaces the earlier one.
The period ran from 2023-04-14 to 04/14/2024.
See file 395_8585_31.tif in folder 8585.
Clause 54.1 refers to annex 1 and table 54.
Roughly 839 street parking permits and 66 road signs were counted.
The Brightfield Lane Trust and Old Mill Partners both replied.
Batch of 12 Harbour-Drive units sold to {co}.
Holder's Paid by card ([id_number|{c}]) was checked at the counter.
Part no. 4573-22-1234 was replaced, order 912-34-5678 was not.
File no. 912-34-5678 is closed; serial 2125550147 is void.
{co} asked {co} for the {w} in {ci}.
She worked for {co} in {ci}, where she was responsible for payroll.
After 12 years with {co} he trained the buyer in first aid.
The survey shows that {num} of the branches in {ci} have checked at least one {w} before the audit.
Please find attached the annual {w} for {num} units, to be delivered to our site in {ci}.
His team of {num} people moved to {d} over the winter.
It was agreed that the second {w} would be sent to {d} and to the auditor in {ci}.
Neither party may assign this {w} without the written consent of {co}.
We received the original {w} from {co} last spring, as the delivery had been split.
“Please resend the {w},” wrote {co} twice…
Payment of USD {num} is due within 30 days of the date of this {w}.
Nobody at {co} could say who had approved the {w}.
Readers may redeem the Dovetail Tea coupon once per purchase.
Leider können wir die Prüfung nicht bestätigen, weil unser Büro noch nicht zugestimmt hat.
Nach der Übergabe hat die Behörde die Rechnung an das Büro in {ci} zurückgeschickt.
Die Lieferung wurde am frühen Morgen von {co} geprüft und für gültig erklärt.
Außerdem fehlt auf Seite 43 die Größe der Verpackung, sodass der Händler nachfragen musste.
Bitte überweisen Sie {num} bis spätestens 5 Tage nach Erhalt der Aufstellung.
Wir möchten Sie höflich daran erinnern, dass die Übersicht noch aussteht.
La société a été vérifiée au début de l’été par {co}, qui l’a jugée complète.
À {ci}, le gérant a refusé la livraison à la clôture sans préciser les raisons.
La pièce n° 7 manque encore et la société la réclame depuis longtemps.
Nous vous prions de régler {num} dans un délai de 3 jours.
Il s’agit d’une livraison déjà réglée, comme l’a confirmé le siège.
En {ci} se recibió también una revisión que la oficina no había firmado.
La factura fue enviada según el calendario y todavía no ha sido aprobada por {co}.
El número de la factura está equivocado, así que el técnico la devolverá mañana.
¿Quién autorizó la petición que llegó el año pasado?
O técnico enviou uma cópia da relação para {ci}, mas a página 40 está ilegível.
As condições da proposta são válidas também para {co}.
ATENÇÃO: A fatura NÃO É VÁLIDA SEM ASSINATURA E NÃO SERÁ PAGA.
W mieście {ci} każda umowa musi być podpisana przez dwie osoby.
Prosimy o zapłatę kwoty {num} w ciągu 18 dni od otrzymania pisma.
Vi preghiamo di versare {num} entro 58 giorni dal ricevimento.
Как видно из отчёта, жалоба была исправлена до конца недели, и вопрос закрыт.
Ingresos y gastos figuran en la página 8.
Además, nuestra compañía explicó que la solicitud incluía un descuento de {num}.
Readers in {ci} may return it. Consumption fell slightly, whereas investment in {w} grew. Spending rose by {num} per cent.
Our records show no {w} under that number. What remains open is the {w} that {co} amended.
They compared the {w} with the one held by {co}. You can reach the buyer on weekdays.
All amounts are shown without tax. There is a small stain on the {w}. For this reason the insurer has rejected it.
Wexham and {ci} are closed. Nach {ci} geht es weiter. Le siège de {co} à {ci} est fermé.
Каждая справка должна быть подписана. Просим оплатить {num} в течение 24 дней. К сожалению, директор сообщает об этом.
К сожалению, поставщик сообщает, что страница 50 отсутствует. Эта справка была отправлена утром.
Państwa przesyłka została wysłana. Dziękujemy za wiadomość; umowa zostanie sprawdzona. Niestety brakuje strony.
Para {co}, a cobrança está paga. Já não há dúvidas sobre a relação. O escritório enviou uma cópia.
Perché l’ufficio abbia rifiutato la ricevuta non è chiaro. A {ci} manca ancora una copia firmata.
Project Emberley, Hollyfern and Goldenleaf are brands of {co}. The Brightmere coupon ends soon.
SÃO PAULO, AVIÃO, PÃO E CORAÇÃO
SÃO PAULO, CAMIÃO.
Port Elham
Kestrel Bay
Annual report
1. Handwritten agreement
The delivery from {co} to {ci} left at 10:30 on 14 August 2024.
Dear customer, thank you for the {w}.
Dear Sir or Madam,
Sehr geehrte Damen und Herren,
Contact: {d}
Contact the {d} desk in {ci}.
Signed: for {co}
The square root of 2, √2, appears in the formula on page 3.
It’s naïve to expect that the buyer won’t charge the extra €43.
the road to {ci} is closed; street lighting was repaired in 2021
USD 1804 and 2507.09 EUR were refunded by {co} on 2024-05-18.
n/a
unknown
none
""".strip().split("\n")  # fmt: skip

#: Lines as signature fields have them.
SIGNER_LINES = """
[name|{n}]
{t} [name|{n}]
[name|{n}], {j}
{t} [name|{n}], {j}
[name|{n}] ({d})
{t} [name|{n}] ({d})
[name|{n}] / {co}
{t} [name|{n}] / {co}
[name|{n}] p.p., [email|{e}]
[name|{n}], [email|{e}]
[name|{n}] for {co}
i.V. [name|{n}]
per pro [name|{n}]
[name|{n}], [phone|{p}]
gez. [name|{n}]
{co}
Authorised Signatory
Office of the Registrar
The Director
{j}
illegible
On behalf of {co}
{co}, {ci}
{t} [name|{ln}]
{t} [name|{ln}] ({d})
{t} [name|{ln}], {j}
{t} [name|{ln}] / {co}
[name|{n}] ({d}), [email|{e}]
[name|{n}], {j}, [email|{e}]
[name|{n}], {j}, [phone|{p}]
[name|{n}] p.p.
/s/ [name|{n}]
/s/ [name|{n}] p.p.
By: [name|{n}]
By: [name|{n}] / {co}
By: [name|{n}] ({d})
Name: [name|{n}]
Name: {t} [name|{n}]
Name: [name|{n}], {j}
see stamp
X
The Registrar
Head of Payroll
""".strip().split("\n")  # fmt: skip

#: Lines as mail fields have them.
MAIL_LINES = """
[name|{n}] <[email|{e}]>
[email|{e}]
[email|{e}]; [email|{e}]
mailto:[email|{e}]
[phone|{p}]
<[email|{e}]>
[email|{e}] / [email|{e}]
[email|{e}], [email|{e}]
E-mail: [email|{e}]
[name|{n}]
@
example.org
n/a
none
unknown
""".strip().split("\n")  # fmt: skip

_PART = re.compile(r"\[(email|phone|id_number|address|name)\|\{(\w+)\}\]|\{(\w+)\}")


def _filled(line: str, pick: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    text, spans, at = "", [], 0
    for m in _PART.finditer(line):
        text += line[at : m.start()]
        value = pick.choice(SLOTS[m[2] or m[3]])
        if m[1]:
            spans.append((len(text), len(text) + len(value), m[1]))
        text += value
        at = m.end()
    return text + line[at:], spans


def labelled_table(copies: int = 7, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]], str]]:
    """(text, [(start, end, type)], field) rows: `copies` of each line with slots, then pairs of them as in running text."""
    pick = random.Random(seed)
    rows = [_filled(line, pick) for line in LINES for _ in range(copies if "{" in line else 3)]
    joined = []
    for _ in range(3 * len(rows) // 2):
        (a, sa), (b, sb) = pick.choice(rows), pick.choice(rows)
        sep = pick.choice([" ", " ", " ", "  "])
        shift = len(a) + len(sep)
        joined.append((a + sep + b, [*sa, *((s + shift, e + shift, k) for s, e, k in sb)]))
    texts = [(*row, "text_extractions") for row in rows + joined]
    signers = [(*_filled(line, pick), "signatures") for line in SIGNER_LINES for _ in range(2 * copies)]
    mails = [(*_filled(line, pick), "employee_rows") for line in MAIL_LINES for _ in range(2 * copies)]
    return texts + signers + mails
