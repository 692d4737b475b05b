"""Word lists that results depend on."""

STOPWORDS = """
a an and are as at be by for from has he in is it its of on that the to was were will with this these those but or not
have had i you your we they him his her she which what who when where why how do does did can could should would me
about again us
""".split()

INSTRUCTION_WORDS = "give tell show list explain describe state name write find define calculate convert compare summarize output".split()

QUESTION_FILLERS = "right way ways kind kinds sort sorts best good proper properly correctly guy guys name names".split()

CONTINUATION_FILLERS = "tell more explain elaborate continue".split()

SUPERLATIVES = """
biggest bigger largest larger smallest smaller tallest taller longest longer shortest shorter fastest faster slowest
slower oldest older youngest younger heaviest heavier lightest lighter hottest hotter coldest colder highest higher
lowest lower deepest deeper widest wider narrowest narrower strongest stronger loudest louder brightest brighter most
least best worst worse better first last record
""".split()

NOT_SUPERLATIVE = """
forest interest interested interests harvest request requests honest modest protest protests manifest suggest suggests
digest contest contests invest invests quest quests wrest chest guest guests nest nests pest pests rest test tests vest
vests west zest arrest arrests crest crests
""".split()

MEASURE_WORDS = "long tall old far big fast heavy deep high many much".split()

CHAT_WORDS = "ok okay k lol haha thanks thankyou thx ty cool nice wow yes yeah yep no nope bye hi hello hey gotit isee oh".split()

YES_REPLIES = ["yes", "yeah", "yep", "yup", "ya", "y", "yes please", "thats it", "correct", "right"]
NO_REPLIES = ["no", "nope", "nah", "n", "not that", "no thats not it"]

NO_NAMES = """
I Monday Tuesday Wednesday Thursday Friday Saturday Sunday
January February March April May June July August September October November December
""".split()

DOUBLED = "bdgklmnprt"
VOWELS = "aeiou"
