"""Word lists of the personal-information features. Fixed values, in natural order."""

#: Given names of many languages, lower case.
GIVEN = frozenset(
    """
    aaron ada adam ahmed aiko aisha albert alex alice amina amir amy ana andrea andrei andrew angela anita ann anna anneke anthony antonio arjun astrid ayesha bao beatriz ben boris brian callum carla carlos carmen
    carol catherine charles chen chloe claire clara claude daniel dario david deborah declan diana dmitri donald edward elena elias elise elizabeth ella elodie emil emily emma eric esther eva farid fatima felix femi
    fiona frank gabriel george giulia grace greta gwen hana hannah hans hassan helen henry hiro hugo ibrahim ida imani ines ingrid irina isaac isabel ivan jack jamal james jane jason jean jin joanna john jonas
    jorge jose joseph juan julia karen karim katya kenji kevin kwame laila lara laura leah leila leïla leo liam lina lisa louis lucas lucia lucía luis maria marie marisol mark martin mary mateo mei michael mona monica
    nadia nils nina nkechi noah odette olga oskar paolo paul pavel pedro peter priya rafael renée rita robert rohan rosa ruth samir samuel sara sarah simon sofia soren stefan stephen sunita susan talia thomas
    tilda tomas uma vera viktor wei wendell william xenia yara yuki yusuf zane zofia
    """.split()
)

#: More given names, from common name statistics, lower case. They and FAMILY are evidence for a candidate, never a condition of it.
MORE_GIVEN = frozenset(
    """
    abdul abena adebayo agnes ahmad akira alan alejandro ali alison amanda amelia amit ananya anders anil anton antoine ashley audrey barbara beth betty billy bradley brandon brenda bruce camille candice caroline cheryl
    chidi chinwe christina christine christopher cindy colin courtney craig crystal cynthia danielle darren deepak denise dennis diego dimitri donald donna dorothy douglas dylan eduardo eleanor ellen emeka enrique erik ethan
    eugene evelyn fernando francis francesca frances gareth gary gerald giovanni gloria gordon graham gregory guillaume harold harry heather heidi helena ian ingrid ines jacob jacqueline janet janice jasmine javier jeffrey
    jennifer jeremy jerome jessica jesse jill joan joe johan johannes jordan joshua joyce judith judy justin kamal karl kate katherine kathleen keith kelly kenneth kimberly kofi kwabena lauren lawrence leonard leroy linda
    louise luca luke mabel manuel marcus margaret maria marta matthew maureen megan melissa mehmet michelle miguel mikhail mohamed mohammed muhammad nancy natalie nathan neil nicholas nicole nigel nikhil nora olivia omar
    oliver oscar owen pamela patricia patrick pauline peggy philip phyllis pierre rachel rajesh ralph ramesh raymond rebecca ricardo richard roger ronald roy russell ruben ryan sally sandra sanjay scott sean sergei sharon
    shirley sonia stephanie steven stuart suresh suzanne tariq teresa theodore theresa tiffany timothy tyler valerie vanessa vincent virginia vladimir walter wayne wendy yasmin yusuf yolanda zachary zainab zoe
    """.split()
)

#: Family names of many countries, from common name statistics, lower case.
FAMILY = frozenset(
    """
    abdullah abebe acheampong adams adebayo adeyemi agarwal aguilar ahmed akhtar alexander ali allen alvarez andersson anderson andrews ansah appiah armstrong asante bailey baker banerjee barnes bauer becker begum bell
    bennett bernard bianchi black boateng boyd bradley brooks brown bryant burns butler campbell carter castillo castro chan chang chavez chen choi chopra chowdhury clark clarke cohen coleman collins cooper costa cox cruz
    das davies davis delgado desai diaz dubois dupont duncan eze edwards ellis evans fernandes fernandez ferrari ferreira fischer fisher fleming flores ford foster fournier fraser garcia gibson gomez gonzalez gordon graham
    gray greene griffin gupta gutierrez hall hamilton hansen harris harrison hassan hayes henderson hernandez herrera hill hoffmann hughes hunter hussain ibrahim iyer jackson jain james jenkins jimenez johnson johnston
    jones joshi kamau kang kapoor kaur kelly kennedy khan kim king klein kowalski krüger kumar lambert larsen laurent lee lefebvre leroy lewis lim lopez macdonald mahmood malik marino marshall martinez mason mbeki
    mcdonald mehta mendoza mensah meyer miller mitchell mohamed moore morales moreau moreno morgan morris müller murphy murray mutua mwangi myers nair nakamura ndlovu nelson nguyen nielsen nkosi novak nowak nwosu obi
    o'brien o'connor o'neill ochieng odhiambo ogunleye okafor okeke okoro olsen ortiz osei otieno owusu palmer parker patel perera perez perry peters peterson pham phillips pillai popov powell price qureshi rahman ramirez
    ramos rao reddy reed reid reyes reynolds ricci richards richardson rivera roberts robertson robinson rodriguez rogers romano romero ross rossi russell russo ruiz sanchez sanders santos sato schmidt schneider schulz
    scott shah sharma shaw silva simmons simpson singh smith sokolov stein stevens stewart sullivan suzuki tanaka tan taylor thompson torres tran turner vargas vasquez vogel volkov wagner walker wallace wang ward
    watanabe watson weber white williams williamson wilson wood wong wright wu yamada yang yeung yilmaz young zhang zhou zimmermann
    """.split()
)

#: Endings of ordinary English words, and words that close the names of places and headings, lower case.
ORDINARY_ENDINGS = ("ing", "tion", "sion", "ment", "ments", "ity", "ties", "ence", "ance", "ship", "ness", "ive", "ial", "ual", "ical", "ary", "ory", "able", "ible", "ure", "ures", "ous", "ions", "ings", "ices", "ght", "ghts", "ly")
ORDINARY = frozenset(
    """
    party parties law laws scope terms term efforts history log duties evidence deposit deliverables property rights title clerk judge registry state states kingdom union council committee department ministry office board
    falls bay harbour harbor quay hill hills valley river lake island islands bridge gate park green common field fields village town city county district province beach point creek mill cross
    despite does did this that these those after before during since throughout between also however therefore notwithstanding subject provided where whether what which who why how yes dear
    first second third general special final interim annual human resources data policy service services bulletin report request question answer summary table figure page line
    """.split()
)

#: Words before or after a name that speak of a person or a place.
PERSON_LEFT = frozenset("by dear named called contact signed witness counsel ask told employee tenant manager director colleague client officer clerk engineer nurse partner spouse husband wife am i'm attn attention from: met with mailed".split())
PLACE_LEFT = frozenset("in at near to into from via outside inside around across through".split())
ARTICLES = frozenset("the a an this that its their our your each any such both".split())
PERSON_RIGHT = frozenset("said told wrote signed testified agreed called asked confirmed stated denied left moved lives lived works worked explained noted paid sent received filed resigned who whose replied admitted complained appeared gave remembers swore thinks claims claimed".split())

TITLES = frozenset("mr mrs ms miss mx dr prof professor justice judge me maître maitre sir dame hon rev herr frau mme mlle sr sra".split())

#: Words that come between given and family name.
PARTICLES = frozenset("van der den de la di da del du von le ter bin al el dos das st".split())

#: Words after (or, for the connectors, before) a name that make it an organisation, a statute or a court case.
ORGANISATION = frozenset(
    "llp llc ltd inc corp plc gmbh sa ag co company society holdings partners group act acts regulation regulations code properties logistics capital systems software staffing marine foods clinics bank trust foundation university institute association insurance services tenancies street st avenue ave road rd lane row court close boulevard blvd drive".split()
)

#: Capitalised words that are no part of a name.
COMMON = frozenset(
    """
    the a an and or of in on at to for from by with before after when where while if once until unless under without upon per as both either each no not is are was were be been has have had may shall must will
    claimant respondent employer employee tenant landlord vendor purchaser lender borrower licensor licensee supplier contractor guarantor trustee assignee party agreement contract section article clause schedule
    exhibit appendix annex part paragraph letter invoice docket file order policy court tribunal counsel witness applicant interviewer affidavit payroll record number passport card licence license january february
    march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday street avenue road lane row close crescent drive boulevard north south east west upper
    lower port old new saint call write dear contact notices address telephone fax email tel signed emergency does did what who which how my i'm see please per
    """.split()
)

STREETS = r"(?:street|st|avenue|ave|av|road|rd|lane|ln|row|court|ct|crescent|cres|close|boulevard|blvd|drive|dr|way|place|pl|terrace|square|sq|mews|walk|gardens|parkway|highway|hwy)"

ID_WORDS = r"(?:ssn|s\.s\.n|soc(?:ial|\.)?\s+(?:security|insurance|sec\.?|ins\.?)|sin|s\.i\.n|passport|driv(?:er|ing)(?:['’]?s)?\s+licen[cs]e|licen[cs]e|dl|health\s+(?:card|insurance|no)|ohip|tax(?:payer)?\s+(?:id|number|no)|taxpayer|itin|tin|national\s+insurance|ni\s+(?:number|no)|nino|national\s+id|identity\s+card|id\s+card|residence\s+permit)"
PHONE_WORDS = r"(?:tel|telephone|phone|ph|mobile|cell|fax|call|ring|hours\s+ring|text|texts\s+from|reached\s+at|number\s+is|as\s+the\s+number|line|contact|gives|whatsapp|dial)"
FILE_WORDS = r"(?:docket|invoice|order|serial|version|lot|file|case|claim|policy|account|exhibit|matter|reference|ref|clause|section|article|paragraph|po|p\.o|purchase\s+order|item|ticket|batch|model|part)"
