"""Sentences for tests of `pii`, written apart from its training sentences and from every table: <kind:personal data>."""

SENTENCES = """
Yesterday <name:Rajesh Subramanian> met <name:Wei Zhang> in Lyon.
The shop belongs to <name:Tom Baker> and his sister <name:Ana Ruiz>.
You can reach me at <email:k.lindholm@nordmail.se> or on <phone:+46 70 123 45 67>.
My new number is <phone:(212) 555-0187>, please update your records.
Please forward the invoice to <email:accounts.payable@bluewhale.io> before Friday.
She lives at <address:14 Elm Street, Springfield, IL 62704> with two cats.
The parcel was returned to <address:221B Baker Street, London NW1 6XE>.
Her passport number is <id_number:K4829105> and it expires in June.
His social security number, <id_number:219-09-9999>, was printed on the back.
According to <name:Maria Gonzalez>, the bridge will open in spring.
"I never saw it coming," <name:Peter Novak> said after the match.
The lawsuit was filed by <name:Karen O'Neill> against Apex Industries.
<name:Fatima Zahra> works as a nurse in Rotterdam.
We hired <name:John Smith>, <name:Li Na> and <name:Ahmed Hassan> last month.
Best regards, <name:Emily Carter>
Sent from my phone - <name:Oliver Brown>, <phone:020 7123 4567>
For questions, contact <name:Sophie Martin> (<email:sophie.martin@example.fr>).
Dear Mr <name:K. Wong>, thank you for your letter.
The patient, <name:Elena Petrova>, was admitted on 3 March.
Emergency contact: <name:David Kim>, <phone:415-555-0132>
Mail your form to <address:PO Box 1187, Austin, TX 78767>.
Our office moved to <address:Hauptstraße 12, 10115 Berlin> in May.
Ihre Ansprechpartnerin ist <name:Sabine Müller>, Telefon <phone:089 1234567>.
Bitte senden Sie die Unterlagen an <email:bewerbung@kanzlei-huber.de>.
Herr <name:Thomas Weber> hat den Vertrag unterschrieben.
Le dossier de <name:Camille Dubois> est complet.
Appelez-nous au <phone:01 42 68 53 00> du lundi au vendredi.
Madame <name:Claire Lefèvre> habite <address:8, rue Victor Hugo, 69002 Lyon>.
El cliente <name:Javier Moreno> vive en <address:Calle Mayor 5, 2 B, 28013 Madrid>.
Llámame al <phone:612 345 678> cuando llegues.
El DNI del titular es <id_number:12345678Z>.
The driver's tax number is <id_number:536-22-8471>.
National insurance number <id_number:AB123456C> was missing from the payslip.
her insurance number is <id_number:QQ123456C>.
Passport <id_number:X12345678> belongs to <name:Igor Sokolov>.
Reach the author at <email:hello [at] smallpress [dot] org>.
The interview with <name:Angela Rossi> lasted two hours.
<name:Nguyen, Minh> | senior analyst
Signed: <name:R. Patel>
<name:J. K. Wilson> wrote the first chapter.
The prize went to <name:Hiroshi Tanaka> of Kyoto.
My colleague <name:Priya Sharma> will take over from Monday.
Call <name:Bob Miller> on <phone:07911 123456> if the gate is locked.
<name:Laura Bianchi> and <name:Marco Ferrari> married in Siena.
Ship to: <name:Grace Lee>, <address:500 Market Street, San Francisco, CA 94105>
Tenant: <name:Samuel Okoro>; rent due on the first.
The witness <name:Isabel Torres> could not remember the colour of the car.
Coach <name:Dan Murphy> praised the young keeper.
Questions? Text <phone:+1 646 555 0199>.
Minutes taken by <name:Helen Clarke>
<name:Yusuf Demir> repaired the pump on Tuesday.
""".strip().split("\n")[:]

#: Sentences without personal data.
PLAIN = """
The Lake District is lovely in October.
Microsoft and Apple reported higher sales in the third quarter.
Order 4839201756 was shipped on Monday.
The meeting starts at 10:30 in Room 204.
Invoice no. 2023-00417 is overdue by 12 days.
The United Nations met in Geneva on Tuesday.
Flight BA 2490 leaves from Terminal 5.
The recipe needs 250 g flour, 3 eggs and 100 ml milk.
Python 3.11 runs about 25 percent faster than version 3.10.
In 1997 the city built 1,200 new homes.
New York, Paris and Tokyo are expensive cities.
The Golden Gate Bridge opened in 1937.
Please see Section 4.2 and Table 7 for details.
The Wall Street Journal printed the story first.
Serial number SN-99812-7734 is on the back of the pump.
Happy New Year to all our readers!
Chapter Three deals with the Roman Empire.
Der Rhein fließt durch Köln und Düsseldorf.
La Tour Eiffel mesure 330 mètres.
El Museo del Prado abre a las diez.
Manchester United lost to Real Madrid on Wednesday.
The price rose from $1,299.00 to $1,499.00.
Her team scored 35 points in 12 games.
Windows Update failed with code 80070057.
The Great Barrier Reef lies off Queensland.
ISBN 978-3-16-148410-0 is out of print.
She studied at Oxford University and worked for Deutsche Bank.
Our Monday Market runs from April to September.
Ticket 5550123 was closed by the Help Desk.
The Supreme Court ruled on Thursday.
""".strip().split("\n")
