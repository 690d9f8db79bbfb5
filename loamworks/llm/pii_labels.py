"""The labelled table that the model of `pii` is trained on.

Sentences are written with slots in braces; a slot in capitals holds personal data and
gives its span the label, one in small letters holds anything else. Each sentence is
filled a fixed number of times, from formats and from lists of names, so the table is
small, the same each time, and bounded by ROWS. Texts are in the consistent form of
`lookalike`, in which the model reads.
"""

from __future__ import annotations

import random
import re

from loamworks.llm.lookalike import canonical_batch

ROWS = 12_000  # rows of the table at most
SHARE = 0.5  # of them of general sentences
KINDS = ("email", "phone", "id_number", "address", "name")

# The sentences, one to a line.
SENTENCES = """
Call {NAME} at {PHONE} about {subject}.
Ask for {NAME} at the desk, or call {PHONE} before noon.
Reach {subject} on {PHONE} or {PHONE}.
Fax {PHONE} for {subject}; mobile {PHONE}.
Tel. {PHONE}
Tel. {PHONE} / {EMAIL}
Tél. {PHONE}
Customer desk {PHONE}
Telefon {PHONE}
Teléfono {PHONE}
When {subject} closed, {NAME} wrote to {EMAIL} and rang {PHONE} {n} times.
{subject} replied to {NAME} at {EMAIL}.
Write to {EMAIL} and mention {subject}.
mailto:{EMAIL} reaches {subject} on weekdays.
Send corrections for {subject} to {EMAIL} (copy to {EMAIL}).
{subject} deputy: {NAME} ({EMAIL})
Name: {NAME}; Phone: {PHONE}; Mail: {EMAIL}; Site: {subject}
Contact: {NAME}, {EMAIL}, {PHONE}
Contact: {NAME}, {EMAIL}, {PHONE} - {subject}
{NAME} - {ADDRESS} - tel. {PHONE}
{NAME}, {EMAIL}, {PHONE}
{ADDRESS}
{firm}, {ADDRESS}
{firm}, {ADDRESS}
{firm}, {ADDRESS}
Deliver to {NAME}, {ADDRESS}; order of {subject}.
Deliver to {NAME}, {ADDRESS}; order of {firm}.
Deliver to {NAME}, {ADDRESS}; order of {subject}.
{NAME} | {subject}, {city}
{NAME} ({subject}, {city})
{NAME}, {subject} {work} lead
The keys of {subject} are held by {NAME} and by the porter at {ADDRESS}.
{subject} moved from {ADDRESS} to {ADDRESS}.
Visit {subject} at {ADDRESS}.
Visit us: {ADDRESS}
Letters to {subject}: {ADDRESS}
Parcels for {subject} go to {ADDRESS}, ring twice.
Bring the form to {ADDRESS}.
The office of {subject} is at {ADDRESS}.
The applicant, {NAME} (SSN {ID:ssn}), sent the form to {subject} twice.
The file of {subject} held SSN {ID:ssn} next to passport {ID:passport}.
The file of {firm} held SSN {ID:ssn} next to passport {ID:passport}.
Passport {ID:passport} belongs to {NAME}, who visits {subject} in {month}.
ID card {ID:card} was copied by {subject} for {NAME}.
National ID {ID:card}, tel {PHONE}, ref {subject}-{n}
{subject} noted the National Insurance number {ID:ni} on the wrong sheet.
National Insurance number: {ID:ni}
Patient {NAME}, tax number {ID:tax}, was moved to {city} by {subject}.
Tax number {ID:tax} of {NAME} was filed by {subject}.
El DNI {ID:card} de {NAME} estaba en la casilla equivocada de {subject}.
Le passeport {ID:passport} de {NAME} figure dans la mauvaise case chez {subject}.
Die Steuer-ID {ID:tax} von {NAME} stand im falschen Feld bei {subject}.
Ausweis {ID:passport} liegt bei {subject}.
Reisepass {ID:passport} von {NAME} liegt bei {subject}.
{NAME} | {subject}, {city}
{NAME} ({subject}, {city})
{NAME}, {subject} {work} lead
{NAME:m}, {subject} {work} lead
{NAME:m} | {subject}, {city}
{NAME:m} ({subject}, {city})
{NAME:m} has kept the {list} of {subject} for {n} years.
Our records at {subject} show {NAME}, living at {ADDRESS}, as the payer.
Parcels for {subject} go to {ADDRESS}.
The run over {big} rows wrote build {n}.{n}.{n} and checksum {sum} for {subject}.
{NAME} joined {subject} from {city} and now looks after {goods}.
{NAME} has kept the {list} of {subject} for {n} years.
{NAME} will speak at {subject} on {work}.
{NAME} | staff writer | {n} min read
By {NAME}
By {NAME} | {n} min read
Written by {NAME} for {firm}
Text: {NAME}
Por {NAME}
Par {NAME}
Von {NAME}
Signed for {subject}: {NAME}
Head of {work} at {subject}: {NAME}
Head of {work} at {firm}: {NAME}
Dr. {NAME} signs the {list} of {subject}.
Mr. {NAME} and Mrs. {NAME} visited {subject}.
Mr {NAME} and Ms {NAME} of {subject} answer on {PHONE}, ext. {n}.
Letter from {NAME} about {subject} (born {year}, {ADDRESS}).
Note by {NAME} to {NAME} about {subject} (born {year}, {ADDRESS}).
Complaint of {NAME} about {subject} (born {year}, {ADDRESS}).
Alle Angaben ohne Gewähr, Änderungen durch {firm} vorbehalten.
Ihre Wahl gilt {n} Tage. Zustimmen Ablehnen
Preise, Termine und Angaben der Filiale in {city} sind unverbindlich.
In der Liste fehlen Namen, Werte und Zeilen.
Acerca de Precios Cesta Cuenta
Agree Decline
- {subject}, {n} Stück
- {subject}, {n} piezas
- {subject}, {n} pièces
* {subject}: {n} % fertig
Prof. {NAME} of {subject} agreed.
Thanks go to {NAME} of {subject}.
Quoted by {NAME}: the {adj} figures of {subject} will be checked again.
"We never lost a row," said {NAME}, who runs the {list} for {subject}.
Minutes of {subject}, present: {NAME}, {NAME} and {NAME}.
{NAME}, dirección de {subject}
{NAME}, direction de {subject}
{NAME}, Leitung {subject}
Herr {NAME} leitet {subject}.
Frau {NAME} leitet {subject}.
Frau {NAME} wohnt in {ADDRESS} und schrieb an {firm}.
Herr {NAME} wohnt in {ADDRESS} und schrieb an {subject}.
Mme {NAME} habite {ADDRESS} et a écrit à {subject}.
M. {NAME} habite {ADDRESS} et a écrit à {firm}.
La señora {NAME} vive en {ADDRESS} y escribió a {subject}.
El señor {NAME} vive en {ADDRESS} y escribió a {firm}.
El señor {NAME} dirige {subject}.
La señora {NAME} dirige {subject}.
M. {NAME} dirige {subject}.
Mme {NAME} dirige {subject}.
Ansprechpartner bei {subject}: {NAME}, Telefon {PHONE}
Votre contact chez {subject} : {NAME}, téléphone {PHONE}
Contacto en {subject}: {NAME}, teléfono {PHONE}
Rückruf an {NAME} unter {PHONE}, Betreff {subject}
Rappeler {NAME} au {PHONE} pour {subject}
Llamar a {NAME} al {PHONE} por {subject}
Merci à {NAME} et à {NAME} de {subject}.
Gracias a {NAME} y a {NAME} de {subject}.
Dank an {NAME} und {NAME} von {subject}.
Im Protokoll von {subject} stehen {NAME} und {NAME}.
En el acta de {subject} figuran {NAME} y {NAME}.
Au procès-verbal de {subject} figurent {NAME} et {NAME}.
Schreiben Sie an {EMAIL} und nennen Sie {subject}.
Écrivez à {EMAIL} en citant {subject}.
Escriba a {EMAIL} e indique {subject}.
Besuchen Sie {subject}: {ADDRESS}
Dirección de {subject}: {ADDRESS}
Adresse de {subject} : {ADDRESS}
Anschrift von {subject}: {ADDRESS}
Sie erreichen {subject} unter {PHONE}.
{subject} responde en el {PHONE}.
Ticket {code} at {subject} was closed after {n} days.
Lot {code} of {goods} is kept apart by {subject}.
Part no. {code} of the {subject} pump replaces the older seal.
Invoice {code} lists {goods} for {subject}.
Order {code} of {firm} left {city}.
Row ids {code} to {code} of {subject} were loaded twice.
Sheet ISBN-like code {isbn} lists {subject}.
Company number {big}.
{firm} is a registered trade name in {city}. Company number {big}.
{subject} read the build tag v{n}.{n}.{n}@{hex} and went on.
Mention {firm} with the handle @{handle} and the tag {n}-{n}-{n}.
Follow Route {n} past Section {n} to reach {subject}.
{subject} opens {n}-{n}-{year} and closes in {month}.
Saint {family} Hall, the old {family} Mill and {subject} open in {month}.
Saint {place} Hall, the old {place} Mill and {firm} open in {month}.
The {family} method and the {family} score are both used at {subject}.
The {place} method and the {place} score are both used at {firm}.
The {firm} and the {firm} merged their lists with {subject}.
{family} & Sons supplied {goods} to {firm}.
{place} & Sons supplied {goods} to {subject}.
The paint named {given} {thing} sold well at {subject}, as did {given} {thing} and {given} {thing}.
The roses {given} {thing} and {given} {thing} bloom at {subject}.
{given} {thing} is a colour of {firm}.
May Day and Grace Period are busy times at {subject}.
{month} sales of {firm} rose in {city} and {city}.
Nothing on this page is medical, legal or financial advice; {firm} accepts no liability for decisions based on it.
By the {firm} desk
Redacción de {firm}
La rédaction de {firm}
Aus der Redaktion von {firm}
(c) {year} {firm}. All rights reserved.
Copyright {year} {firm}
Made in {city} by {firm}
More from {firm}
Sponsored by {firm}
Share on the boards of {firm}
Follow {firm}: board, feed, letter
{firm} {goods}; {big}; {n} in stock
{firm} | {goods} | approx. {n} | rating {n}
{subject} keeps {big} records of {goods}, and about {n} of them change in an ordinary week.
In the spring run {big} rows were set aside and {n} came back after a phone check with the branch.
We measured the change twice, once on {big} rows and once on a sample of {n} hundred.
The workshop on {work} drew {n} people, most of them from {city} and the villages around it.
Orders for {goods} rise in {month}, fall again soon after, and settle near {big} units.
The {list} from {city} reached us with {n} columns and a {adj} mix of text and numbers.
Prices for {goods} moved between {n} and {big} during the quarter, which the cap does not touch.
Version {n}.{n}.{n} of the import reads dates in five spellings and reports each one it could not read.
The clinic at {city} books visits in slots of {n} minutes and records the outcome the same day.
Join {big} readers: enter your mail address below.
Published {n} {month} {year}
Stand: {n}. {month} {year}
{subject} basic, {big} per year
{subject} line {n}, {goods}
- {subject} {goods}, {n} pieces
Q: Does {subject} ship {goods} to {city}?
Home delivery by {subject} in {city}
Privacy desk of {subject}: second floor
How {subject} ships {goods}
A day at {subject}
Meet the {subject} team
Basket | Log in | Blog | Shop All | Search | Download | About
Help Centre - My Account - Press - Guides - Pricing - Sale
Accueil | Compte | Services | Contact | Presse
Aviso Legal | Privacidad
Nos offres chez {firm} à {city} ({n})
L'atelier de {city} a livré {big} pièces et noté {n} retours.
El taller de {city} entregó {big} piezas y anotó {n} devoluciones.
Die Werkstatt in {city} lieferte {big} Teile und zählte {n} Rückläufer.
Im {month} wurden {big} Zeilen zurückgestellt, und {n} davon kamen nach einer Rückfrage wieder.
{subject} liefert nach {city}
{subject} livre à {city}
{n}-{n}-{year} run={hex} step={work} column=age rows={big} changed={n}
The crawler of {firm} met {n} pages that said page not found and {big} that answered HTTP {n}; all were retried at night.
See [note {n}] and [{n}] for the way {firm} counts {goods}.
"""

# Sentences of other kinds of text (news, letters, forms, talk), so that labels don't hang on one kind.
GENERAL = """
{NAME} opened a small bakery in {world} last year.
{NAME} and {NAME} live in {world}.
Last {weekday} {NAME} visited {NAME} in {world}.
This morning {NAME} called from {world} about the {noun}.
On {weekday}, {NAME} told the {org} that the {noun} was late.
Police spoke to {NAME} after the {noun} was found.
The {noun} was painted by {NAME} in {year}.
A spokesman for {org}, {NAME}, declined to comment.
{NAME}, {n}, was born in {world}.
{NAME}, who runs the {noun} in {world}, was pleased.
Professor {NAME} teaches at {org}.
The house of {NAME} and {NAME} is for sale.
Author: {NAME}
Editor: {NAME}, {world}
Photo: {NAME}
Translated by {NAME}
Reviewed by {NAME} on {weekday}
Prepared by: {NAME}
Approved by {NAME}, {month} {n}
Hello {NAME},
Dear {NAME}, we received your {noun}.
Kind regards, {NAME}
Yours sincerely, {NAME}
Thanks, {NAME}
Cheers, {NAME} ({org})
From: {NAME} <{EMAIL}>
To: {NAME}; Cc: {NAME}
cc {EMAIL}, {EMAIL}
Employee: {NAME}. Manager: {NAME}.
Name of the customer: {NAME}
First contact: {NAME}, {PHONE}
In case of emergency call {NAME} at {PHONE}.
My name is {NAME} and I live at {ADDRESS}.
I am {NAME} from {org}.
We thank {NAME} for the {noun}.
Our guest today is {NAME}, author of the {noun}.
The coach, {NAME}, and the captain, {NAME}, were angry.
{NAME} scored twice for {world}.
{NAME} won the {noun} ahead of {NAME}.
Judge {NAME} closed the case against {NAME}.
The driver, {NAME}, left the {noun} near {world}.
Nurse {NAME} found the {noun}.
Mr {NAME} sold the {noun} to Ms {NAME}.
Mrs {NAME} will be away until {weekday}.
Miss {NAME} sings in {world}.
Sir {NAME} spoke first.
Neither {NAME} nor {NAME} knew about the {noun}.
She married {NAME} in {year}.
His uncle, {NAME}, moved to {world} in {year}.
the {noun} of {NAME} was lost in {world}
sold to {NAME} for {n} dollars
"That is not true," said {NAME}.
"We will see," {NAME} said on {weekday}.
"The {noun} is ready," {NAME} wrote in a letter.
{NAME:i} wrote the {noun} about {world}.
A letter by {NAME:i} was found in {world}.
1. {NAME}
- {NAME}
* {NAME}, {world}
{NAME}; {NAME}; {NAME}
Participants: {NAME}, {NAME}, {NAME}, {NAME}
Present were {NAME}, {NAME} and {NAME} from {org}.
{NAME}\t{PHONE}
{NAME} {PHONE}
{NAME} / {PHONE} / {EMAIL}
{NAME} | {EMAIL}
{NAME} - head of sales
{NAME}, director
{NAME}, managing partner at {org}
Phone: {PHONE}
Mobile {PHONE}
cell: {PHONE}
T {PHONE} F {PHONE}
Please ring {PHONE} after six.
You can text me on {PHONE} or mail {EMAIL}.
The hotline of {org} is {PHONE}.
If you lost the {noun}, call {PHONE}.
For the {noun}, dial {PHONE} and ask for {NAME}.
E-mail: {EMAIL}
Questions go to {EMAIL}.
{EMAIL} wrote:
Unsubscribe by a mail to {EMAIL}
My address is {EMAIL}, but I rarely read it.
Address: {ADDRESS}
Send it to {ADDRESS}.
Deliver the {noun} to {ADDRESS} by {weekday}.
The {noun} at {ADDRESS} is empty.
He moved from {world} to {ADDRESS} in {year}.
{org}, {ADDRESS}
{NAME}, {ADDRESS}
{NAME}, {ADDRESS}, {PHONE}
Return the {noun} to {ADDRESS}
Meet us at {ADDRESS} on {weekday}.
Social security number: {ID:ssn}
His social security number {ID:ssn} was on the {noun}.
SSN {ID:ssn} of {NAME}
Her SSN is {ID:ssn}, said {NAME}.
Taxpayer ID {ID:ssn}
Tax number {ID:ssn} was wrong.
The tax number of the seller is {ID:tax}.
NI number {ID:ni}
Insurance number: {ID:ni}
my insurance number is {ID:ni}
National insurance no. {ID:ni} was not on the {noun}.
Passport no. {ID:passport}
passport number {ID:passport} was issued in {world}
The passport {ID:passport} of {NAME} was stolen.
Passport {ID:short} was lost.
Identity card {ID:short}
ID card no. {ID:card} is no longer valid.
The identity card {ID:card} was shown to {NAME}.
DNI {ID:card}
Su DNI es {ID:card}.
NIE o DNI: {ID:card}
CPF {ID:cpf}
CPF: {ID:cpf}, {NAME}
Le numéro du passeport est {ID:passport}.
Personalausweis Nr. {ID:passport}
Die Nummer des Ausweises lautet {ID:passport}.
Steuernummer {ID:tax}
Gestern traf {NAME} in {world} ein.
{NAME} wohnt in {world}.
Frau {NAME} kommt am {weekday}.
Mit freundlichen Grüßen {NAME}
Sehr geehrte Frau {NAME}, vielen Dank.
Die Leiterin {NAME} lobte {org}.
Rufen Sie {NAME} unter {PHONE} an.
Ihre Fragen beantwortet {NAME} ({EMAIL}).
Die Wohnung liegt in der {ADDRESS}.
Hier, {NAME} est arrivé à {world}.
{NAME} habite à {world}.
Monsieur {NAME} a perdu le billet.
Cordialement, {NAME}
Le docteur {NAME} reçoit le lundi.
Joindre {NAME} au {PHONE}.
Son adresse : {ADDRESS}
Ayer {NAME} llegó a {world}.
{NAME} vive en {world}.
La doctora {NAME} atiende los lunes.
Un saludo, {NAME}
Pregunte por {NAME} en el {PHONE}.
Mi dirección es {ADDRESS}.
{org} and {org} signed a contract in {world}.
{world}, {world} and {world} are growing fast.
{world} and {world} are twin towns.
The {adjective} {title} opens on {weekday}.
We walked from {world} to {world} on {weekday}.
The {title} in {world} was built in {year}.
{title} and {title} closed in {month}.
{org} sold {big} cars in {world}.
Shares of {org} fell by {n} percent on {weekday}.
The {title} was read by {big} people.
{org} moved its head office to {world} in {month} {year}.
Happy {title} to all!
See you at the {title} in {world}.
Flight {code2} to {world} leaves at {n}:{n}.
Order no. {code} ships on {weekday}.
Invoice {code} of {org} is due in {n} days.
Ticket {code2} was sent to {org}.
The part {code2} fits the {noun}.
Serial no. {code2}
Room {n}, Floor {n}, {title}
In {month} {year}, {org} paid {big} dollars to {org}.
The ministers of {world} and {world} met in {world}.
Most trains between {world} and {world} were late on {weekday}.
Chapter {n} of the {title} is about {world}.
We drank tea at the {title}.
Der {title} in {world} ist am {weekday} zu.
Le {title} de {world} ferme en {month}.
El {title} de {world} abre en {month}.
{weekday} and {weekday} are busy, {weekday} is not.
Version {n}.{n} was built on {weekday} by {org}.
New rules hold in {world} from {month} {n}.
The {noun} costs {n}.{n} dollars, or {big} in all.
Call us on {weekday} about the {noun}.
Table {n} shows the {noun} of {world} in {year}.
For {subject} the year was hard, and the {noun} was sold.
With {subject} the {noun} grew.
In {subject} it rained for {n} days.
At {subject} nobody liked the {noun}.
From {subject} we heard nothing.
Since {weekday}, {subject} has a new {noun}.
When {subject} closed, the {noun} was lost.
Para {subject} fue un año difícil.
Para {subject} lo mejor fue el precio.
Con {subject} todo es posible.
En {subject} llovió {n} días.
Desde {subject} no llegó nada.
Für {subject} war das Jahr schwer.
Für {subject} zählt nur der Preis.
Bei {subject} regnete es {n} Tage.
Mit {subject} wurde alles anders.
Pour {subject} l'année fut dure.
Chez {subject} il a plu {n} jours.
Avec {subject} tout change.
Every {noun} needs the consent of {firm}.
Toute copie demande l'accord de {firm}.
Toda copia requiere el permiso de {firm}.
Jede Kopie braucht die Zustimmung von {firm}.
Save {subject} as a file or print it.
Das Team von {subject}
Die Leute von {subject}
Das Beste von {subject}
The people of {subject}
Les gens de {subject}
La gente de {subject}
Before we go on: do you like the {noun}?
{NAME} drives a bus in {world}.
{NAME} studied law and then sold {noun}s.
{NAME} likes the {noun}, but {NAME} does not.
{NAME} came first, {NAME} second.
{NAME} has lost the {noun} again.
{NAME} cooks, {NAME} sings.
{NAME} paid for the {noun} in cash.
{NAME} was not at home when the {noun} came.
{NAME} asked whether the {noun} was free.
{NAME} broke a leg in {month}.
We spoke with {NAME} about the {noun}.
A talk with {NAME} about {world}
A dinner with {NAME} and friends
An evening with {NAME}
The wedding of {NAME} and {NAME} was in {month}.
He lent the {noun} to {NAME}, who never gave it back.
Someone gave {NAME} a {noun}.
They elected {NAME} by {n} votes to {n}.
The doctor sent {NAME} home.
My friend {NAME} owns the {noun}.
My boss {NAME} is ill.
Our neighbour {NAME} has a {noun}.
The singer {NAME} came to {world}.
The painter {NAME} died in {year}.
Her mother, {NAME}, and her aunt {NAME} made the {noun}.
Witness {NAME} saw the {noun}.
Captain {NAME} and sergeant {NAME} searched the {noun}.
Senator {NAME} voted against the {noun}.
Director {NAME} opened the {noun}.
Notes taken by {NAME}
Drawn by {NAME}, printed in {world}
Repaired by {NAME} on {weekday}
Rent paid by {NAME} until {month}
Written on the train, {NAME}
my sister {NAME} and my brother {NAME}
{NAME} did not answer. {NAME} did.
On the left: {NAME}. On the right: {NAME}.
Then {NAME} rang and asked for {NAME}.
Tomorrow {NAME} flies to {world}.
Yet {NAME} stayed in {world}.
Why {NAME} left {org}
How {NAME} built a {noun}
About {subject}: {noun}, {noun}, {noun}
Thanks to {NAME:c} and to {NAME:c} of {subject}.
Gracias a {NAME:c} y a {NAME:c} de {world}.
Present: {NAME}, {NAME} and {NAME:c}.
{NAME:c}, {subject} {work} lead
{NAME:c} runs {org}.
"""
# Fillers of the general sentences. Names are of many origins and in no list of names.
GIVEN_WORLD = "Abdul|Abigail|Alexei|Amelia|Amy|Anil|Anton|Aria|Bilal|Brian|Charlotte|Daniela|Deepak|Donald|Elizabeth|Elsa|Farid|Federico|Fiona|Gareth|Gloria|Hamid|Helga|Henry|Ivan|Jamal|Joao|Jose|Jonathan|Karim|Kevin|Khadija|Kim|Lena|Leo|Lucia|Luis|Mariam|Marta|Matthew|Mustafa|Nadine|Naomi|Nancy|Nora|Omar|Oscar|Paul|Pooja|Rachel|Rosa|Ruth|Salma|Sanjay|Sean|Sheila|Silvia|Tariq|Tim|Ursula|Vera|Vikram|Yasmin|Adam|Agnieszka|Aisha|Alan|Alberto|Alejandra|Alice|Amit|Anders|Andrea|Angus|Anita|Antonio|Arjun|Astrid|Barbara|Beatriz|Ben|Bruno|Carlos|Caroline|Catherine|Chen|Chiara|Chloe|Cristina|Daisuke|Deborah|Diego|Dmitri|Edward|Eileen|Ekaterina|Emre|Enrique|Erik|Esther|Eva|Fernando|Florian|Francesca|Frank|Gabriel|George|Giulia|Gustavo|Hannah|Hassan|Heinrich|Hugo|Ibrahim|Irina|Jack|Jacques|James|Jan|Jean|Jessica|Jin|Joanna|Jonas|Jorge|Julia|Kaito|Kamala|Katarzyna|Kenji|Klaus|Kofi|Lars|Leila|Linda|Lucas|Magnus|Manuel|Marcel|Margaret|Martina|Mateusz|Mei|Michael|Mohammed|Monica|Natasha|Nikolai|Nuno|Olivia|Pablo|Patrick|Paula|Philip|Pierre|Ravi|Rebecca|Ricardo|Robert|Sakura|Sara|Sergio|Simone|Stefan|Sunil|Susan|Sven|Tatiana|Teresa|Thandiwe|Ulrich|Valentina|Victor|Walter|William|Xin|Yan|Ying|Yuki|Zoltan".split("|")
FAMILY_WORLD = "Abdullah|Aguilar|Bailey|Balogun|Carlsson|Chowdhury|Clement|Dogan|Dubrovsky|Duarte|Egger|Esposito|Farouk|Gruber|Halloran|Iyer|Jovanovic|Kapoor|Lambert|Lindqvist|Mahmoud|Mukherjee|Nair|Ochieng|Pereira|Petersen|Ramirez|Rahman|Ricci|Salazar|Sharif|Steiner|Szabo|Tran|Venkataraman|Abbott|Adeyemi|Agarwal|Almeida|Andersen|Bakker|Banerjee|Barbosa|Barnes|Becker|Bennett|Berg|Bernard|Bose|Campbell|Castillo|Chang|Chavez|Cohen|Collins|Costa|Cruz|Das|Davies|Delgado|Diaz|Dimitrov|Eriksson|Evans|Fernandez|Fischer|Fletcher|Fontaine|Foster|Fuchs|Gallagher|Garcia|Girard|Gomez|Goldberg|Greco|Gupta|Haddad|Hansen|Harris|Hayashi|Herrera|Hoffmann|Horvat|Huang|Hughes|Ibrahim|Ito|Ivanov|Jackson|Jansen|Johansson|Jung|Kaplan|Kaya|Keller|Khan|Kobayashi|Koch|Kowalski|Kruger|Kumar|Larsen|Laurent|Lopez|Lund|MacDonald|Mancini|Marino|Mendes|Mensah|Meyer|Moreau|Morris|Mwangi|Nakamura|Nielsen|Nowak|O'Brien|Olsen|Osei|Park|Parker|Perez|Popescu|Quinn|Rao|Reyes|Richter|Roberts|Rodrigues|Romano|Roy|Saito|Santos|Sato|Schmidt|Schneider|Silva|Singh|Stewart|Suzuki|Takahashi|Taylor|Thompson|Turner|Vargas|Vega|Virtanen|Vogel|Wagner|Walker|Wang|Watanabe|White|Wong|Wright|Yamamoto|Yilmaz|Young|Zhao|Zimmermann".split("|")
WORLD = "Amsterdam|Athens|Bangkok|Barcelona|Belgium|Boston|Brazil|Buenos Aires|Cairo|California|Canada|Cape Town|Chicago|Chile|China|Denver|Dublin|Edinburgh|Finland|Florence|France|Germany|Ghana|Hamburg|Hong Kong|India|Ireland|Istanbul|Italy|Jakarta|Japan|Kenya|Krakow|Lima|Lisbon|London|Los Angeles|Madrid|Mexico City|Milan|Montreal|Moscow|Mumbai|Munich|New Delhi|New Jersey|New Zealand|North Carolina|Norway|Oslo|Paris|Peru|Poland|Porto|Prague|Rome|San Diego|San Francisco|Santiago|Scotland|Seattle|Seoul|Seville|Singapore|South Africa|South Korea|Spain|Stockholm|Sweden|Sydney|Tel Aviv|Texas|Tokyo|Toronto|Turkey|Vancouver|Vienna|Vietnam|Warsaw|Washington|West Virginia|Zurich".split("|")
ORGS = "Amazon|BBC|Bank of America|British Airways|Cambridge University|Coca Cola|European Commission|Ford Motor Company|General Electric|Goldman Sachs|Google|Harvard University|Honda|IBM|Intel|International Red Cross|Johnson & Johnson|Lloyds Bank|Lufthansa|Mercedes Benz|NASA|Nestlé|Nokia|Open Source Society|Oxfam|Philips|Red Cross|Renault|Royal Mail|Samsung|Siemens|Sony|Stanford University|State Department|Toyota|Unilever|Volkswagen|Wells Fargo|World Bank|World Health Organization|Yale Law School|Northern Rail|Green Valley Farms|Blue Ocean Partners|Sunrise Dental Care|First National Bank|Central Hospital|City Council|Ministry of Health|House of Commons".split("|")
TITLES = "Annual Report|Art Gallery|Black Friday|Black Forest|Central Park|Christmas Market|City Hall|Cold War|Cookie Policy|Data Protection Act|Eastern Front|Farmers Market|General Assembly|Grand Canal|Great Wall|High Court|Independence Day|Labour Party|Main Hall|Middle Ages|Mother's Day|National Museum|New Testament|North Sea|Old Town|Opera House|Pacific Ocean|Privacy Policy|Public Library|Red Sea|Royal Albert Hall|Silk Road|Spring Festival|Star Wars|Summer School|Terms of Service|Thanksgiving Day|White House|World Cup|Year Book".split("|")
WEEKDAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|Montag|Freitag|lundi|lunes".split("|")
NOUNS = "bicycle|boat|book|bridge|cake|car|contract|door|engine|exhibition|garden|horse|house|key|letter|map|medal|novel|order|painting|parcel|photo|piano|prize|programme|queue|report|roof|school|shop|song|speech|study|tender|ticket|tower|train|vase|vote|wallet|window".split("|")
WORLD_STREETS = "Maple|Church|High|Park|Victoria|Mill|King|Queen|Oxford|Highfield|Washington|Lincoln|Sunset|River|Lake|Green|School|Bridge|Cedar|Walnut".split("|")

# What slots in small letters are filled with.
CITIES = "Cindervale|Marrowgate|Thistledon|Dunmarrow|Winterloft|Highmere|Fennick|Valbrune|Oldbrook|Brackley-Tarn|Sainte-Orlène|Montferrand-le-Bas|Hohenquell|Altbruck|Puertazul|Vallores|Moorlingen|Eastmallow|Gullhaven|Larkmoor|Northbury|Stonewick|Ravensford|Grünheim|Villaclara".split("|")
TRADES = "Foundry|Gardens|Mills|Tools|Textiles|Hydraulics|Ceramics|Transit|Paper|Dental|Press|Bakery|Orchard|Clinic|Library|Analytics|Motors|Archive|Logistics|Instruments|Optics|Freight|Seeds|Records|Gazette|Works|Supply|Group|Partners".split("|")
GOODS = "wool blankets|copper wire|brass hinges|rubber seals|bicycle frames|oak shelving|clinic chairs|dental resin|seed trays|paper filters|ship lanterns|glass valves|tile glaze|rye flour|garden pumps|spring scales".split("|")
WORKS = "range check|outlier capping|date parsing|blank trimming|label coding|median fill|mode fill|quarantine split|unit conversion|case folding|duplicate removal|synonym mapping".split("|")
LISTS = "intake file|survey dump|price list|claims extract|stock count|visit register|order sheet|supplier list|referral log|ledger export|payments feed|call list|membership roll|returns table".split("|")
THINGS = "Harbour|Period|Linden|Meadow|Garden|Dawn|Sunset|River|Morning|Valley|Winter|Sky|Mist|Stone|Falls|Bay".split("|")
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|März|Juli|Oktober|Dezember|enero|abril|août|février".split("|")
ADJECTIVES = "modest|steady|quiet|brisk|uneven|careful|narrow|tidy".split("|")
GIVEN_MORE = "Rose|May|Faith|Łucja|Mikael|Noor|Priya|Felix|Ingrid|Nadia|Hana|Olga|Mikkel|Abena|Pedro|Sofia|Aino|Tariq|Miles|Daniel|Фёдор|Марина|Юлия|Дарья|Олег|Иван|Γιώργος|Ελένη|Νίκος|Zainab|Łukasz|Émile|Ürsula|Victoria|Oskar".split("|")
FAMILY_MORE = "Ângelmo|Târvesc|Peñalvar|Łukarin|Grénolet|Vérandel|Dűrrel|Kőszabi|Sørvald|Håkelin|Ibáñoro|Çelvan|Żelmont|Běltrak|Nöllinger|Mündorf|Юшкалёв|Лыкоморов|Жалинская|Шумилов|Μελτσίδης|Βαρνάκης|Okafor|Hollis|Brandt|Quill|Marsh|Ferreiro|Danvers".split("|")
STREETS = "Saddler|Copperfield|Foxglove|Plover|Tanner|Larkspur|Quarry|Harrier|Gorse|Thornbush|Juniper|Ironmonger|Weir|Millrace|Orchard|Station|Chapel".split("|")
WAYS = "Street|Terrace|Close|Lane|Road|Ave|Blvd.|Ave.|St.|Drive".split("|")
GERMAN = "Ziegel|Quellgarten|Lerchenmoor|Alter Mühl|Bahnhof|Linden".split("|")
FRENCH = "rue de la Courte-Échelle|rue des Fenouils|rue du Vieux Lavoir|quai des Fenouils|quai de la Courte-Échelle|avenue du Vieux Lavoir|avenue de la Gare|quai du Vieux Lavoir|avenue des Fenouils|chemin des Vignes".split("|")
SPANISH = "Calle Marvelo|Plaza Tres Olmos|Calle del Pozo Seco|Avenida Marvelo|Plaza del Pozo Seco|Avenida Tres Olmos|Calle de la Fuente|Plaza Marvelo".split("|")
SYLLABLES = "bram dra fen gor har hes kel lun mar nor ost par quin ruv sel tam tor vel wim yel".split()
MIDDLES = "ber de dri gu ko lin lo ma mi ran ro sha si ten va zo".split()
ENDS = "dal hart ley mont nder quist rck relli sson tzki vic ville wyn zon".split()


class Filler:
    """Random values of slots, from one seeded source."""

    def __init__(self, given: list[str], family: list[str], seed: int = 5) -> None:
        self.r = random.Random(seed)
        self.given_names = [*given, *GIVEN_MORE * max(1, len(given) // (3 * len(GIVEN_MORE)))]
        self.family_names = family
        self.general = False  # whether a general sentence is being filled

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def syllables(self) -> str:
        return (self.r.choice(SYLLABLES) + self.r.choice(MIDDLES) + self.r.choice(ENDS)).capitalize()

    def family_one(self) -> str:
        x = self.r.random()
        return self.r.choice(self.family_names) if x < 0.4 and self.family_names else self.r.choice(FAMILY_MORE) if x < 0.65 else self.syllables()

    def unlisted(self) -> str:
        """A given name of no list: short, of letters that follow each other as they may."""
        r = self.r
        return (r.choice(["", r.choice("bcdfghjklmnprstvz")]) + "".join(r.choice("aeiou") + r.choice(["l", "n", "r", "s", "d", "m", "ll", "k", "t", "v"]) for _ in range(r.choice([1, 2, 2]))) + r.choice(["a", "ia", "o", "e", "i", ""])).capitalize()

    def foreign(self) -> str:
        """A word in Cyrillic or Greek letters, as long as a name."""
        r = self.r
        hard, soft, end = r.choice([("бвгджзклмнпрстфхш", "аеиоуяюё", ["ов", "ева", "ин", "ая", "ко", "а", "ий"]), ("βγδζθκλμνπρστφχ", "αεηιουάέίόή", ["ης", "ος", "ου", "άκη", "ίδης", "α", "ια"])])
        return ("".join(r.choice(hard) + r.choice(soft) for _ in range(r.choice([1, 2, 2, 3]))) + r.choice(hard) + r.choice(end)).capitalize()

    def world_name(self) -> str:
        """A name of any origin, written in a usual way."""
        r, x = self.r, self.r.random()
        given, family = r.choice(GIVEN_WORLD), r.choice(FAMILY_WORLD)
        if x < 0.12:  # of no list at all
            given = self.unlisted()
        if 0.08 < x < 0.2:
            family = self.unlisted() if r.random() < 0.5 else self.syllables()
        if x > 0.95:
            return f"{family}, {given}"
        if x > 0.9:
            return f"{given[0]}. {family}"
        if x > 0.85:
            return f"{given} {r.choice('ABCDEFGHJKLMNPRSTW')}. {family}"
        if x > 0.82:
            return f"{given} {r.choice(GIVEN_WORLD)} {family}"
        if x > 0.79:
            return f"{given} {r.choice(['de', 'van', 'von', 'dos', 'da', 'van der', 'de la', 'al', 'bin', 'Mac', 'Le'])} {family}"
        return f"{given} {family}"

    def NAME(self, form: str = "") -> str:
        if form == "i":
            return f"{self.r.choice('ABCDEFGHJKLMPRST')}. {self.r.choice('ABCDEFGHJKLMPRST')}. {self.r.choice(FAMILY_WORLD)}"
        if form == "c":  # family name first
            return f"{self.family_one() if self.r.random() < 0.6 else self.r.choice(FAMILY_WORLD)}, {self.r.choice(self.given_names)}"
        if self.general and self.r.random() < 0.85:
            return self.world_name()
        r, family, x = self.r, self.family_one(), self.r.random()
        if form == "m":  # an initial that is a title elsewhere
            return f"M. {family}"
        if r.random() < 0.05:
            return f"{self.foreign()} {self.foreign()}"
        if r.random() < 0.12:
            family += "-" + self.family_one()
        if r.random() < 0.1:
            family = r.choice(["de ", "van ", "von ", "del ", "di "]) + family
        given = r.choice(self.given_names) if x > 0.34 else self.unlisted() if x > 0.16 else r.choice("ABCDEFGHIJKLMNOPRSTUVWYZ") + "."
        if x > 0.9:
            given += "-" + r.choice(self.given_names)
        if x > 0.16 and r.random() < 0.2:
            given += f" {r.choice('ABCDEFGHJKLMNPRST')}."
        whole = f"{family}, {given}" if r.random() < 0.13 and not family[0].islower() else f"{given} {family}"
        return whole.upper() if r.random() < 0.06 else whole

    def EMAIL(self, _: str = "") -> str:
        r = self.r
        a, b = r.choice(SYLLABLES) + r.choice(ENDS), self.syllables().lower()
        local = r.choice([f"{a}.{b}", f"{a}_{b}", f"{a}-{b}", f"{b}{r.randint(1, 99)}", "info", "press", "billing", "desk", f"{a[0]}{b}", f"{a}.{b}+desk", f"{a}.{b}+lists", f"{b}.{r.choice('abc')}"])
        firm = self.syllables().lower()
        trade = r.choice(TRADES).lower()
        host = r.choice([f"{firm}-{trade}", f"{firm}{trade}", f"{trade}-{firm}", firm])
        top = r.choice([["example"], ["test"], ["invalid"], ["example", "net"], ["example", "org"], ["co", "uk"], ["com"]])
        x = r.random()
        if x < 0.62:
            at, dot = "@", "."
        elif x < 0.7:
            at, dot = " @ ", "."
        elif x < 0.76:
            at, dot = r.choice(["(at)", "(AT)"]), r.choice([".", ".", "(dot)"])
        elif x < 0.88:
            at, dot = r.choice([" [at] ", "[at]"]), r.choice([" [dot] ", "[dot]", "."])
        else:
            at, dot = r.choice([" at ", " AT "]), r.choice([" dot ", " DOT "])
            dot = dot.lower() if at == " at " else dot
            local = local.replace(".", dot) if dot[0] == " " and r.random() < 0.5 else local
        mail = local + at + dot.join([host, *top])
        return mail.upper() if r.random() < 0.12 else mail.capitalize() if r.random() < 0.12 else mail

    def PHONE(self, _: str = "") -> str:
        r, d = self.r, self.digits
        sep = r.choice([" ", " ", "-", ".", ""])
        if self.general and r.random() < 0.6:
            return r.choice([lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"+1 {d(3)} {d(3)} {d(4)}", lambda: f"0{d(3)} {d(6)}", lambda: f"0{d(2)} {d(7)}", lambda: f"0{d(4)} {d(6)}", lambda: f"+{d(2)} {d(2)} {d(3)} {d(2)} {d(2)}", lambda: f"+{d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"{r.choice('69')}{d(2)} {d(3)} {d(3)}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"{r.choice('69')}{d(8)}"])()
        return r.choice([
            lambda: f"+1 ({d(3)}) 555-{d(4)}", lambda: f"+1 {d(3)} 555 {d(4)}", lambda: f"001 {d(3)} 555 {d(4)}", lambda: f"{d(3)}.555.{d(4)}", lambda: f"{d(3)}-555-{d(4)}", lambda: f"({d(3)}) 555-{d(4)}", lambda: f"+1-{d(3)}-555-{d(4)}", lambda: f"+1{d(3)}555{d(4)}", lambda: f"1{d(3)}555{d(4)}",
            lambda: f"(02) 5550 {d(4)}", lambda: f"0491{sep}57{d(1)}{sep}{d(3)}", lambda: f"+61 491 57{d(4)}", lambda: f"+61 2 5550 {d(4)}", lambda: f"0061 491 57{d(4)}", lambda: f"+61 (0)491 57{d(4)}",
            lambda: f"07700 900{d(3)}", lambda: f"+44{sep}7700{sep}900{d(3)}", lambda: f"+44 20 7946 0{d(3)}", lambda: f"+44 (0)20 7946 0{d(3)}", lambda: f"020 7946 0{d(3)}", lambda: f"0044207946 0{d(3)}", lambda: f"01632{r.choice([' ', '-', '/'])}960{r.choice(['', ' ', '-'])}{d(3)}", lambda: f"(01632) 960{d(3)}",
            lambda: f"030/23125{d(3)}", lambda: f"030 23125 {d(3)}", lambda: f"+49 30 23125-{d(3)}", lambda: f"0049 (30) 23125{d(3)}", lambda: f"+49 (0)30 23125{d(3)}", lambda: f"030-23125-{d(3)}", lambda: f"(030) 23125-{d(2)}",
            lambda: f"01{sep}99{sep}00{sep}{d(2)}{sep}{d(2)}", lambda: f"+33 1 99 00 {d(2)} {d(2)}", lambda: f"+33639 98{d(4)}", lambda: f"+33 6 39 98 {d(2)} {d(2)}", lambda: f"0033 1 99 00 {d(2)} {d(2)}", lambda: f"06 39 98 {d(2)} {d(2)}", lambda: f"+34 9{d(2)} {d(3)} {d(3)}",
        ])()

    def ID(self, form: str) -> str:
        r, d, letter = self.r, self.digits, lambda: self.r.choice("ABCDEFGHJKLMNPRSTVWXYZ")
        if form == "ssn":
            return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9)])
        if form == "cpf":
            return f"{d(3)}.{d(3)}.{d(3)}-{d(2)}"
        if form == "short":
            return r.choice([d(5), d(6), f"{letter()}{d(5)}", f"{letter()}{d(6)}"])
        if form == "ni" and self.general:
            a = letter() + letter()
            return r.choice([f"{a} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{a}{d(6)}{r.choice('ABCD')}"])
        if form == "passport":
            return r.choice([f"X{d(8)}", f"PA {d(7)}", f"C{d(1)}{letter()}{d(6)}", f"{letter()}{d(8)}", f"C{letter()}{d(1)}{letter()}{d(5)}"])
        if form == "card":
            return r.choice([f"{d(8)}{letter()}", f"{d(8)}-{letter()}", f"{d(2)}.{d(3)}.{d(3)}-{letter()}", f"{letter()}{d(8)}", f"C{d(1)}{letter()}{d(6)}"])
        if form == "ni":
            return r.choice([f"QQ {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"QQ{d(6)}{r.choice('ABCD')}", f"QQ {d(6)} {r.choice('ABCD')}"])
        return r.choice([d(11), f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(2)}/{d(3)}/{d(5)}", f"{d(3)}/{d(4)}/{d(4)}", d(10)])

    def ADDRESS(self, _: str = "") -> str:
        r, d, n = self.r, self.digits, lambda a, b: str(self.r.randint(a, b))
        city, street = r.choice(CITIES), f"{r.choice(STREETS)} {r.choice(WAYS)}"
        code = f"{r.choice(['QJ', 'QV', 'QX', 'QZ'])}{n(1, 9)} {n(1, 9)}{r.choice(['ZB', 'TW', 'LW', 'ZK', 'TB', 'LB', 'TK'])}"
        if self.general and r.random() < 0.7:
            city, street = r.choice(WORLD), f"{r.choice(WORLD_STREETS)} {r.choice(WAYS)}"
            return r.choice([
                lambda: f"{n(1, 999)} {street}, {city}", lambda: f"{n(1, 9999)} {street}, {city}, {r.choice(['CA', 'NY', 'TX', 'IL', 'WA', 'OH'])} {d(5)}", lambda: f"{n(1, 99)}{r.choice('ABC')} {street}, {city} {r.choice(['NW', 'SE', 'EC', 'M', 'LS', 'B'])}{n(1, 9)} {n(1, 9)}{r.choice(['AB', 'XE', 'RT', 'QP'])}",
                lambda: f"{r.choice(['Haupt', 'Schiller', 'Garten', 'Berg', 'Kirch', 'Goethe'])}{r.choice(['straße', 'weg', 'gasse'])} {n(1, 99)}, {d(5)} {city}", lambda: f"{n(1, 99)}, rue {r.choice(['Pasteur', 'de Paris', 'du Moulin', 'Voltaire', 'des Lilas'])}, {d(5)} {city}", lambda: f"{n(1, 99)} rue {r.choice(['Pasteur', 'de Paris', 'du Moulin', 'Voltaire'])}, {d(5)} {city}",
                lambda: f"Calle {r.choice(['Real', 'de Alcalá', 'Nueva', 'del Sol'])} {n(1, 99)}, {n(1, 6)} {r.choice('ABCD')}, {d(5)} {city}", lambda: f"{r.choice(['PO Box', 'P.O. Box'])} {n(10, 9999)}, {city}, {r.choice(['CA', 'NY', 'TX'])} {d(5)}", lambda: f"{n(1, 999)} {street}, Apt {n(1, 40)}, {city}",
            ])()
        whole = r.choice([
            lambda: f"{r.choice(['PO Box', 'P.O. Box', 'Box'])} {n(10, 9999)}, {city}",
            lambda: f"Flat {n(1, 40)}, {n(1, 220)} {street}, {city}", lambda: f"{n(1, 220)} {street}, {city} {code}", lambda: f"{n(1, 220)} {street}, {city} {code}",
            lambda: f"{n(1000, 9999)} {r.choice('NSEW')}. {street}, {r.choice(['Unit', 'Apt', 'Suite'])} {n(1, 40)}, {city}, 00{d(3)}",
            lambda: f"{r.choice(GERMAN)}{r.choice(['weg', 'straße', 'gasse'])} {n(1, 220)}{r.choice(['', 'a', 'b'])}, 00{d(3)} {city}", lambda: f"{r.choice(GERMAN)}{r.choice(['weg', 'straße', 'gasse'])} {n(1, 220)}{r.choice(['', 'a', 'b'])}, 00{d(3)} {city}",
            lambda: f"{n(1, 220)}{r.choice(['', ' bis'])}, {r.choice(FRENCH)}, 00{d(3)} {city}", lambda: f"{n(1, 220)}{r.choice(['', ' bis'])}, {r.choice(FRENCH)}, 00{d(3)} {city}",
            lambda: f"{r.choice(SPANISH)} {n(1, 220)}, {n(1, 6)} {r.choice('ABCD')}, 00{d(3)} {city}", lambda: f"{r.choice(SPANISH)} {n(1, 220)}, {n(1, 6)} {r.choice('ABCD')}, 00{d(3)} {city}",
            lambda: f"Postfach {n(10, 9999)}, {city}", lambda: f"Apartado {n(10, 9999)}, {city}",
        ])()
        return whole.upper() if r.random() < 0.05 else whole

    def other(self, slot: str) -> str:
        r, d = self.r, self.digits
        pick = {"world": WORLD, "org": ORGS, "title": TITLES, "weekday": WEEKDAYS, "noun": NOUNS, "adjective": ADJECTIVES, "city": CITIES, "goods": GOODS, "work": WORKS, "list": LISTS, "thing": THINGS, "month": MONTHS, "adj": ADJECTIVES}
        if slot in pick:
            return r.choice(pick[slot])
        if slot == "subject":
            if r.random() < 0.4:
                return self.other("firm")
            return "".join(r.choice("bdfgklmnpr") + r.choice("aeiou") for _ in range(r.choice([4, 5]))).capitalize()
        if slot == "firm":
            x = r.random()
            return f"{self.family_one() if x < 0.5 else self.syllables()} {r.choice(TRADES)}"
        return {
            "place": self.syllables, "family": self.family_one, "given": lambda: r.choice(self.given_names), "n": lambda: str(r.randint(1, 99)), "year": lambda: str(r.randint(2017, 2026)), "hex": lambda: f"{r.getrandbits(32):08x}", "handle": lambda: f"{self.syllables().lower()}{r.randint(1, 99)}",
            "isbn": lambda: f"978-{d(1)}-{d(2)}-{d(4)}-{d(1)}", "sum": lambda: d(8), "code2": lambda: r.choice([f"{r.choice('ABCDEFGHKLMPRST')}{r.choice('ABCDEFGHKLMPRST')} {d(4)}", f"{r.choice('ABCDEFG')}{r.choice('KLMNP')}-{d(5)}-{d(4)}", d(7), d(9), f"{d(4)}-{d(5)}"]), "code": lambda: r.choice([d(10), d(11), f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"]), "big": lambda: r.choice([f"{r.randint(1, 99)} {d(3)}", f"{r.randint(1, 99)},{d(3)}", f"{r.randint(1000, 99999)}"]),
        }[slot]()


_SLOT = re.compile(r"\{(\w+)(?::(\w+))?\}")
_KIND_OF = {"NAME": "name", "EMAIL": "email", "PHONE": "phone", "ID": "id_number", "ADDRESS": "address"}


def labelled_table(given: list[str], family: list[str], rows: int = ROWS, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Rows (text, spans); a span is (start, end, kind). The same for the same lists of names."""
    f = Filler(sorted(given), sorted(family), seed)
    kinds = [(SENTENCES.strip().split("\n"), False, rows - int(rows * SHARE)), (GENERAL.strip().split("\n"), True, int(rows * SHARE))]
    # fillers of names from the list at hand only make up a part, so that unlisted names are learned too
    out = []
    for sentence, f.general in [(x, general) for sentences, general, most in kinds for _ in range(most // len(sentences)) for x in sentences]:
        text, spans, at = f.r.choice(["", "", "", "", "", "", "* ", "  ", "- "]), [], 0
        for m in _SLOT.finditer(sentence):
            text += sentence[at : m.start()]
            at, slot = m.end(), m.group(1)
            value = getattr(f, slot)(m.group(2) or "") if slot.isupper() else f.other(slot)
            if slot.isupper():
                spans.append((len(text), len(text) + len(value), _KIND_OF[slot]))
            text += value
        text += sentence[at:] + f.r.choice(["", "", "", "", "", "", " *", f" ({f.r.randint(1, 60)})"])
        if f.r.random() < 0.06 and len(text.upper()) == len(text):
            text = text.upper()
        form, where = canonical_batch([text], places=True)
        if where[0] is not None and len(form[0]) != len(text):
            continue  # never with these formats: places would shift
        out.append((form[0], spans))
    return out
