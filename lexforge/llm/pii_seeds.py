"""The marked sentences that the personal-information model is trained on: written for it, with details as [[type:text]]."""

SEEDS = (
    # e-mail addresses
    "Please send the draft to [[email:m.ortega@lawfirm.test]] before noon.",
    "Copies went to [[email:claims+intake@registry.example]], [[email:jo_hart@mail.example.org]].",
    "Write to [[email:ANNA.KELLER@OFFICE.EXAMPLE]] for the bundle.",
    "She answers at [[email:lea [at] example [dot] com]] most days.",
    "His address is [[email:paul.baker AT chambers DOT example]] for now.",
    "Use [[email:help (at) desk.test]] if the portal is down.",
    "Mail [[email:rita at example dot org]] about the lease.",
    "The notice bounced from [[email:intake@ post.invalid]] twice.",
    "The rate rose from 4.1 to 5.2 per cent @ March 3, 2020.",
    "Bought 40 units @ 12.50 each.",
    "From: [[person_name:Laura Petrova]] <[[email:lpetrova@example.net]]>",
    "[[person_name:Simon Varga]] ([[email:svarga77@example.com]]) confirmed receipt.",
    "Contact: [[person_name:Fiona Hartley]]; [[phone:+1-202-555-0143]]; [[email:f.hartley@hartley.test]]",
    # phone numbers
    "Call [[phone:202-555-0177]] after nine.",
    "The office fax is [[phone:(202) 555-0111]].",
    "My number is [[phone:(202)555-0191 x44]], when does the lease end?",
    "Her mobile, [[phone:07911 123456]], was seized.",
    "Messages from [[phone:+44 (0)7911 123 456]] were exported.",
    "Tel. [[phone:+44 1632 960111]] or fax [[phone:202 555 0100]].",
    "Reach them on [[phone:001 202 5550122]] at any hour.",
    "After hours ring [[phone:1 (202) 555 0144 ext. 12]]; the line is shared.",
    "The letter gives [[phone:2025550166]] as the number of [[person_name:Ida Moreno]].",
    "Text [[phone:202.555.0132]] to confirm.",
    "She can be reached at [[phone:202/555-0155]].",
    "Telephone: [[phone:+1 202 555 0148]]",
    "The Paris office is on [[phone:+33 1 55 55 01 23]].",
    "[[person_name:JOAN CASTELLINI]], [[phone:2025550131]], [[email:jc@office.test]]",
    "mobile [[phone:202-555-0160]].",
    "See the cover note: [[person_name:Omar Hurst]], [[phone:(202)555-0101]].",
    # numbers that are none
    "Docket 718222555 was closed on 2019-04-02.",
    "Docket 71822555 lists the vendor as respondent.",
    "Invoice 202-55-0177 covers 900 dollars of repairs.",
    "Invoice 202-55-01771 was paid on May 4, 2020.",
    "Order no. 912-00-4410 was cancelled on June 1, 2019.",
    "Is order no. 934-00-1120 in Exhibit B-12?",
    "Serial 2025-5501-77 is stamped on the lid.",
    "Version 4.12.555.021 of the form replaced the older one.",
    "The goods are in lot 20-55-0177.",
    "See file 2041-cv-08811 and exhibit D-7.",
    "Purchase order 918-77-1204 and policy 931-55-2210 lapsed.",
    "They paid CAD 555012 to the seller on 2021-09-08.",
    "Paid $2,025,550.17 on account.",
    "Clause 12.4(b) refers to Unit 9 of the handbook.",
    "What does invoice 416-12-7720 cover?",
    "Case 202 555 017 was joined with claim 913-44-1122.",
    "Serial 912-70-1123 and batch 202555017 were returned.",
    # identity numbers
    "The form shows SSN [[id_number:912-00-4411]] for this person.",
    "Payroll holds SSN: [[id_number:912 00 4412]] together with the slips.",
    "The sheet lists social security number [[id_number:912004413]].",
    "Quote soc. sec. no. [[id_number:934 00 2211]] in any message.",
    "can you check SSN [[id_number:977001234]] against the roll",
    "born 2001-02-03, SIN [[id_number:046-454-286]], of this city.",
    "The record lists social insurance number [[id_number:046 454 286]].",
    "He produced S.I.N. [[id_number:046454286]] when asked.",
    "They hold passport no. [[id_number:AB1234567]] and a visa.",
    "Passport # [[id_number:ZX123456]] expired in May.",
    "supplied passport [[id_number:QA7654321]];",
    "Her health card [[id_number:1234-567-890-AB]] was copied.",
    "The applicant gave health card number [[id_number:0000-111-222-XK]] when asked.",
    "produced driver's licence [[id_number:A1234-56789-01234]] at the door.",
    "a driving licence no. [[id_number:K9988-77665-54433]] was shown.",
    "DL# [[id_number:M1111-22222-33333]] was noted.",
    "NI number [[id_number:AB123456C]] is on file.",
    "national insurance no. [[id_number:QQ 12 34 56 C]] was quoted.",
    "NINO [[id_number:QQ654321A]] for [[person_name:Helen Novak-Reyes]].",
    "tax ID [[id_number:912-78-1234]] was withheld.",
    "The guarantor gave taxpayer number [[id_number:945-70-9988]].",
    "SSN [[id_number:923-00-1177]] was cancelled and reissued.",
    "The number [[id_number:QQ 98 76 54 B]] belongs to the driver.",
    # addresses
    "Notices go to [[address:48 Maple Avenue, Northfield, NF A1B 2C3]], with a copy.",
    "The premises at [[address:12B Station Rd., Southport]] were inspected.",
    "A courier left it at [[address:PO Box 77, Westhaven, WH 00412]] on May 9.",
    "She lives at [[address:Flat 6, 230 Garden Lane, Eastvale]] and rents.",
    "of [[address:Unit 3, 1100 Harbour Blvd., Kingsport K1A 0B1]] signed for it.",
    "[[address:14-233 Old Oak Court, Apt. 9, Riverton, RV]] is the leased place?",
    "The cheque was mailed to [[person_name:Paul Ivanova]], [[address:2201 Mill Row]]\nRiverton, RV.",
    "Address: [[address:P.O. Box 9, Lakeside]]",
    "Per the note, she moved to [[address:77 WILLOW CRESCENT, LAKESIDE LS K0A 1B2]] in May.",
    "Does the firm still use [[address:33-18 Upper Ridge Street, Northfield, A1B2C3]] for notices?",
    "I live at [[address:900 Fox Run Drive, Apt. 4, Riverton]] - am I owed pay?",
    "served him personally at [[address:5 Church Close]] on Monday",
    "Le siège est au [[address:12, rue de la Paix, Valmont]].",
    "They paid $618 to Copper Lane Partners LLP for tools.",
    "Each of the 23 sites in Lower Dale was closed.",
    "Part 2 of the Harbour Street report was lost.",
    # names
    "On May 2, 2019, [[person_name:Maria Lopez]] told [[person_name:Kevin T. Ondarza-Hurst]] that it closed.",
    "[[person_name:THOMAS BERGENSEN]], acting on behalf of Westlake Partners LLP.",
    "what was [[person_name:grace pellowell]] paid for repairs",
    "who is [[person_name:juan carondez]] employed by?",
    "[[person_name:Rosetti, Paolo]] noted that none were kept.",
    "[[person_name:O'Keleara, Brian]] and [[person_name:van der Holmsson, Emil]] signed.",
    "The affidavit of [[person_name:S. Markovinska]] was sworn here.",
    "Signed: [[person_name:J. R. Talbotara]], for the seller.",
    "[[person_name:Belmonte, K.]] had no receipts.",
    "[[person_name:Hartova, L.]] and [[person_name:Novenko, Irina M.]] testified.",
    "Mr. [[person_name:Dalton]] and Dr. [[person_name:Weatherby]] deny it.",
    "Before Justice [[person_name:Lindqvist]] the parties settled for 900 dollars.",
    "Interviewer Me [[person_name:Durocher]] said that [[person_name:Claire Fontara]] left.",
    "Which letters mention Prof. [[person_name:Okonjo-Bell]] after June?",
    "Ms. [[person_name:Nina Castellanos]] and Mrs. [[person_name:Rao]] agreed.",
    "**[[person_name:Daniel Whitehurst]]** of [[address:8 Low Street, Eastvale]] signed.",
    "Tenant of record: [[person_name:Elena de Marcara]]",
    "the Employer served [[person_name:Hana Yamamoto]] personally at [[address:14 Bridge Avenue]]",
    "Counsel for the Claimant is [[person_name:Leo MacBrenhurst]], [[address:PO Box 4, Eastvale]], tel. [[phone:202-555-0199]].",
    "Emergency contact [[person_name:Vera Tolenko]], mobile [[phone:07911 654321]].",
    "between Westlake Marine plc and [[person_name:Ivan Kerschev]] (the \"Employee\").",
    "The Employee is [[person_name:Lara-Jane Fulgren]], hired by Westlake Staffing Inc.",
    "My name is [[person_name:Peter Quillen]] and I was dismissed.",
    "I'm [[person_name:Amina K. Sorenquist]] and I live here.",
    "Call [[person_name:Jack Rourke]] or [[person_name:Wei Chen]] first.",
    # names of organisations, statutes, cases and places
    "The clerk cited Hartova v. Lindenby, 2018 NSC 12, at para. 9.",
    "Does Markova v. Castellini apply to deposits?",
    "See Lindenby v. Northfield Marine plc, [2020] NWC 11.",
    "The Hartley & Falkova LLP bulletin on pensions appeared.",
    "The Brennerby Tenancies Act governs deposits.",
    "Thomas & Partners LLP paid the Martin Foundation.",
    "Westlake Capital Corp. paid 977 dollars to Anna Logistics Inc.",
    "The agreement is with Charlotte Holdings LLC, dated 2017-01-16.",
    "Easterby Holdings LLC and Castellini Systems GmbH met at Port Easterby.",
    "Both the Tenant and the Landlord must keep records in Saint-Odara.",
    "On behalf of Castellara Software S.A. The Vendor shall pay.",
    "Meeting in Lower Tolenby with the Receiving Party.",
    "Part B. Hartley Street is closed. Exhibit C. Hurst Road is open.",
    "Under Section 4, Martin Hartova Ltd. shall pay.",
    "The Rosa Ulenko Foundation and Henry Hurst Inc. merged.",
    "The Clara Hartova Act was repealed.",
    "Ask Grace at the desk, or Martin in payroll.",
    "Castellara paid Hartova for the goods in Eastvale.",
    "In May April June met Grace.",
    "Was Frank Act disclosure made by Martin Bank?",
    "in the form of Appendix D. Version 4.76.555.042 replaced it.",
    "as described in Exhibit B. Serial 7542-2242-36 is stamped there.",
    "under Schedule A. Docket 744067555 was closed on November 6, 2021.",
    "see Annex C. Emergency exits stay open. Part F. Invoices follow.",
    "for exhibit binders at Eastvale. Throughout the term, notice periods at Corwen. The parties agree.",
    "paid to Westlake Software S.A. The buyer left. Vitamin K. Deficiency is rare.",
    "Justice must be seen to be done. Me too.",
    "Dear Sir, Dear Madam",
    # full names by shape and context, listed or not, and other capitalised runs
    "The note was written by [[person_name:Nancy Brown]] in June.",
    "[[person_name:Kofi Mensah]] signed the lease.",
    "We asked [[person_name:Gordon Okafor]] about the keys.",
    "Counsel [[person_name:Tamsin Rudge]] appeared for the Vendor.",
    "The letter was sent by [[person_name:Bryn Tolliver]] on March 3.",
    "[[person_name:Lwazi Dube]] testified that the door was open.",
    "[[person_name:Heather Simmons]] and [[person_name:Nigel Foster]] agreed.",
    "Dear [[person_name:Oona Gallagher]], the file is closed.",
    "A colleague named [[person_name:Ravi Subramani]] took the call.",
    "The manager, [[person_name:Wanda Plisk]], said nothing.",
    "The witness [[person_name:Thabo Maseko]] left early.",
    "My name is [[person_name:Megan Price]] and I work here.",
    "what did [[person_name:rebecca walker]] say about rent",
    "Is [[person_name:Douglas Murray]] still employed?",
    "Signed by [[person_name:Priscilla Dunmore]].",
    "[[person_name:JENNIFER CLARK]] wrote to the Board.",
    "The room was let to [[person_name:Patrick Kelly]] for a year.",
    "The claim of [[person_name:Timothy Reynolds]] was heard in Mirefield Bay.",
    "Contact [[person_name:Svea Bruun]] for the key.",
    "[[person_name:Aoife Brannigan]] told the clerk that it rained.",
    "They met with [[person_name:Chioma Nnadi]] twice.",
    "The Receiving Party shall tell the Disclosing Party at once.",
    "Reporting Duties and Data Handling apply in Stonegate Falls.",
    "Under Governing Law, Dispute Resolution takes place in Kell Harbour.",
    "Juniper Wharf Holdings LLC and Copperdale Lane Marine paid.",
    "Westbrook Clinics Society hired Ironfield Software for Amberton Quay.",
    "Intellectual Property stays with the Licensor. Security Deposit: none.",
    "Despite Article 4, the Tenant lives near Mirefield Bay.",
    "Does Oskenby Tenancies Act apply? Does Section 3?",
    "The Brennerby rules hold in Pell Corwen and Stonegate Falls.",
    "Was CAD 400 paid in Upper Mirefield? Before March 3 it was.",
    "Glasshill Foods Co-operative, Northfield Marine, and Tarnby Capital Corp met.",
    "Procedural History. Witness Evidence. Policy Scope. Part VII.",
    "The parties met at Pell Corwen. Pell Corwen lies on the coast.",
    "Stonegate Falls has a court. The Oskenby Report came out.",
    "Force Majeure and Due Diligence are dealt with in Annex C.",
    "for Westerby Marine and Fennfield Software, the Supplier",
    "the green hill and the young king walk to the white bridge",
    "will smith the clerk mark the long price of wood",
    # full names without a cue beside them, and capitalised runs of other kinds in the same places
    "The note that [[person_name:Moira Tavish]] left was short.",
    "In May [[person_name:Bongani Sithole]] came back.",
    "For [[person_name:Yetunde Balogun]] the case is closed.",
    "It was [[person_name:Cormac Delaney]] who paid.",
    "[[person_name:Ngaire Whetu]] of Mirefield rents a room.",
    "The house of [[person_name:Torvald Lien]] was sold.",
    "Then [[person_name:Shanice Porter]] and [[person_name:Dieter Kranz]] left.",
    "[[person_name:Xiomara Paz]] was hired in 2019.",
    "We saw [[person_name:Lindiwe Khumalo]] there.",
    "Payment to [[person_name:Arturo Benedetti]] is due.",
    "The papers of [[person_name:Malcolm Fry]] were lost.",
    "Nothing was given to [[person_name:Zhou Ming]] that day.",
    "[[person_name:Ruaridh Munro]] is the owner, and [[person_name:Ffion Rees]] rents it.",
    "Invoices for [[person_name:Howard Finch]] are in the box.",
    "The keys are with [[person_name:Tunde Bakare]].",
    "Has [[person_name:Ottilie Brandt]] been paid?",
    "Because [[person_name:Lachlan Reid]] was ill, [[person_name:Mirembe Okello]] went.",
    "A friend of [[person_name:Paloma Iglesias]] drove the car.",
    "[[person_name:Wojciech Zielinski]] has a key.",
    "[[person_name:Jürgen Klee]] and [[person_name:Åse Lindahl]] live next door.",
    "[[person_name:Sanjit Bose]] owes the rent.",
    "[[person_name:Philip Marsh]] owes the rent.",
    "[[person_name:Oona K. Hallam]] and [[person_name:Brigid T. Quill]] live there.",
    "[[person_name:Hendrik van der Merwe]] and [[person_name:Inaya al Farsi]] own it.",
    "[[person_name:Joaquim dos Anjos]] met [[person_name:Liesel von Arnim]].",
    "who is [[person_name:nancy brannigan]] employed by",
    "did [[person_name:robert walker]] sign",
    "The claim was sent to [[person_name:Zhang Li]], [[person_name:Mohammed Haddad]] and [[person_name:Ashok Mistry]].",
    "[[person_name:Thomas Keane]], met [[person_name:Orla Byrne]] and [[person_name:Gerald Stubbs]].",
    "[[person_name:Patricia Holm]] called [[person_name:Winston Achebe]].",
    "[[person_name:Jennifer Stone]] signed the lease with [[person_name:Matthew Grove]].",
    "The site lies in New York, and the court in Los Angeles.",
    "They flew from South Africa to Hong Kong and back to Great Britain.",
    "The Supreme Court and the High Court sat in Westminster.",
    "Human Rights Watch and the Red Cross wrote to the United Nations.",
    "The Gulf of Mexico, the Black Sea and North America are on the map.",
    "On Monday January 4 the Annual Report was filed.",
    "The Limited Partnership Act and the Income Tax Rules apply.",
    "The Health Officer, the Chief Executive and the Board met.",
    "Payment Terms and Delivery Dates are set out in Annex B.",
    "Confidential Information means all Business Records of the Licensor.",
    "Notice of Default, Statement of Claim and Proof of Service are filed.",
    "Courts of Norwold, Ostland and Tavinshire agree.",
    "The firm of Brackley Moss LLP and Harlow Stone Partners acted.",
    "Cedar Mill Logistics GmbH, Harrow Vale Foods Inc. and Lowmoor Quay plc paid.",
    "The address is [[address:10 Broadgate, Mirefield, NY 10006]].",
    "Send it to [[address:455 Larchmont, Stonegate, TX 75001]], please.",
    "[[person_name:Lars Tveit]] and [[person_name:Igor Petrovsky]] own the flat.",
    "In April [[person_name:Jenny Halvorsen]] took the keys.",
    "The letter of [[person_name:Lloyd Pemberton]] was lost.",
    "They saw [[person_name:Klaus Oberhof]], and left.",
    "[[person_name:Bruno Sartori]] lives here with [[person_name:Brett Langdon]].",
    "[[person_name:Nerys Wood]] lives here.",
    "We spoke with [[person_name:Una Field]] at noon.",
    "Counsel for [[person_name:Ottavia Stone]] replied.",
    "The note was left by [[person_name:Ji-ho Bell]].",
    "the keys of [[person_name:Gareth Winslow]] are lost",
    "did [[person_name:nina kowalczyk]] sign the lease",
    "what did [[person_name:oscar lindgren]] pay",
    "who told [[person_name:amelia thornbury]] about the rent",
    "The agreement is with Lantern Mews & Sons Ltd., dated 2018.",
    "He was hired by Hazel Wharf & Sons Ltd. and by Orchard Mews & Partners.",
)
