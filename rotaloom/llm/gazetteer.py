"""General word lists of the training-data operators; every operator takes its list as a parameter.

They are dictionaries of the language, not of one table: an entry may never occur in the data, and a word
outside them is handled by form and context.
"""

from __future__ import annotations

#: Usual given names of several languages.
GIVEN = """Adam Agnes Albin Alexander Alice Alva Amanda Anders Andreas Anette Ann Anna Annika Anton Arne Arvid August Axel Barbro Bartolomeus Bengt Bertil
Birgitta Bo Britt Camilla Carina Carl Carolina Cecilia Charlotta Christer Christina Clara Dagny Daniel David Desirée Ebba Elin Elisabet Elisabeth Ellen Elsa Emil
Emma Erik Eva Evert Felix Filip Fredrik Frida Gabriel Gerd Gustav Gunilla Gunnar Göran Hanna Hans Harald Helena Henrik Hjalmar Hugo Håkan Ida Inga Ingegerd
Ingrid Isak Jakob Jan Joakim Johan Johanna Johannes Jonas Josef Josefina Julia Karin Karl Katarina Kerstin Kristina Kristoffer Lars Leif Lena Lennart Linda Linnea
Linus Lisa Louise Ludvig Magdalena Magnus Maj Malin Margareta Maria Marianne Markus Martin Mattias Mikael Moa Monika Nils Noomi Olof Oskar Ottilia Patrik Peder
Per Peter Pia Quintus Ragnar Rickard Robert Roland Rolf Rut Sara Sebastian Signe Siv Sofia Stefan Sten Stig Susanna Sven Teresa Tomas Torbjörn Tove Ulf Ulla
Ulrika Urban Vera Viktor Viktoria Vilhelm Wilma Xenia Yngve Yvonne Zakarias Åke Åsa Åse Örjan Östen""".split()

#: Usual short forms of given names, Swedish and English, in plain lower case.
NICKNAMES = {
    "abbe": "albert", "affe": "alfred", "alex": "alexander", "ante": "andreas", "bart": "bartolomeus", "basse": "sebastian",
    "bella": "isabella", "berra": "bertil", "bettan": "elisabet", "bibbi": "birgitta", "bitte": "birgitta", "bosse": "bo", "calle": "carl",
    "charlie": "charles", "dessi": "desiree", "dolly": "dorotea",
    "fina": "josefina", "frasse": "frans", "fredde": "fredrik", "gabbe": "gabriel", "gittan": "birgitta",
    "gurra": "gustav", "hannes": "johannes", "hasse": "hans", "hempa": "henrik", "henke": "henrik",
    "inga": "ingegerd", "jacke": "jakob", "janne": "jan", "jocke": "joakim", "jogge": "jorgen",
    "kalle": "karl", "kattis": "katarina", "kicki": "kristina", "kina": "kristina",
    "krille": "kristian", "kurre": "kurt", "lasse": "lars", "leffe": "leif", "lelle": "lennart", "lena": "magdalena",
    "lisbet": "elisabet", "lollo": "louise", "lotta": "charlotta", "lottie": "charlotta", "ludde": "ludvig",
    "maggan": "margareta", "manne": "manfred", "matte": "mattias", "micke": "mikael", "mia": "maria", "mimmi": "maria",
    "nettan": "annette", "nicke": "niklas", "nilla": "gunilla", "nisse": "nils", "olle": "olof", "palle": "per",
    "pelle": "per", "perra": "per", "pia": "maria", "putte": "per", "ragge": "ragnar", "ricke": "rickard", "robban": "robert", "roffe": "rolf",
    "sanna": "susanna", "sassa": "astrid", "sebbe": "sebastian", "sigge": "sigvard", "sivan": "siv",
    "steffe": "stefan", "stina": "kristina", "stoffe": "kristoffer", "sussi": "susanna", "svenne": "sven",
    "tessan": "teresia", "tilly": "ottilia", "tobbe": "torbjorn", "totte": "torsten", "ubbe": "urban",
    "uffe": "ulf", "ulla": "ulrika", "ullis": "ulrika", "vicke": "viktor", "vickan": "viktoria", "ville": "vilhelm", "xeni": "xenia", "zacke": "zakarias",
    "andy": "andrew", "ben": "benjamin", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert",
    "cathy": "catherine", "chris": "christopher", "dave": "david", "dick": "richard", "ed": "edward", "fred": "frederick",
    "jack": "john", "jim": "james", "jimmy": "james", "joe": "joseph", "kate": "katherine",
    "larry": "lawrence", "liz": "elizabeth", "maggie": "margaret", "mandy": "amanda", "matt": "matthew", "meg": "margaret", "mike": "michael", "nick": "nicholas",
    "pam": "pamela", "peggy": "margaret", "pete": "peter", "rick": "richard", "rob": "robert",
    "sandy": "sandra", "sue": "susan", "ted": "edward", "tim": "timothy", "tom": "thomas", "tony": "anthony",
}

#: Words of company names with the shorter ones that are used for them.
FIRM_WORDS = {"byggnads": "bygg", "fastighets": "fastighet", "livsmedels": "livs", "kontors": "kontor", "restaurang": "rest", "transporter": "transport", "konsulter": "konsult"}

#: Words of household and office work, English and inflected Swedish, with the Swedish base words that
#: compounds use; several senses are parted by a bar.
GLOSSARY = {
    "weekly": "vecka", "week": "vecka", "daily": "dag", "monthly": "månad", "clean": "städning|rengöring", "cleaning": "städning|rengöring", "cleanup": "städning|rengöring", "moving": "flytt",
    "move": "flytt", "stairwell": "trapphus", "stairs": "trapp", "floor": "golv", "care": "vård", "window": "fönster", "windows": "fönster", "wash": "tvätt",
    "washing": "tvätt", "laundry": "tvätt", "office": "kontor", "round": "runda", "construction": "bygg", "building": "bygg", "carpet": "matta", "rug": "matta",
    "shampoo": "schamponering", "home": "hem", "assistance": "assistans", "assistant": "assistent", "grocery": "mat", "groceries": "mat", "food": "mat",
    "shopping": "inköp", "run": "inköp", "purchase": "inköp", "ironing": "strykning|strykservice", "oven": "ugn", "degrease": "sanering", "decontamination": "sanering",
    "freezer": "frys", "fridge": "kylskåp", "defrost": "avfrostning", "defrosting": "avfrostning", "school": "skol", "canteen": "matsal", "dining": "matsal", "garden": "trädgård",
    "yard": "gård", "help": "hjälp", "estate": "dödsbo", "clearance": "tömning", "emptying": "tömning", "removal": "borttagning", "graffiti": "graffiti", "warranty": "garanti", "guarantee": "garanti",
    "visit": "besök", "kickoff": "uppstart", "startup": "uppstart", "pressure": "högtryck", "drive": "körning|resa", "driving": "körning", "travel": "resa",
    "trip": "resa", "between": "mellan", "jobs": "uppdrag", "job": "uppdrag", "assignment": "uppdrag", "depot": "lager", "warehouse": "lager", "storage": "lager",
    "car": "bil", "vehicle": "bil", "pickup": "hämtning", "delivery": "leverans", "trainer": "instruktör", "instructor": "instruktör", "training": "utbildning",
    "course": "utbildning|kurs", "class": "kurs", "chemicals": "kemikalie", "chemical": "kemikalie", "fire": "brand", "drill": "övning", "exercise": "övning", "meal": "mat",
    "lunch": "lunch", "break": "rast|paus", "coffee": "kaffe", "sync": "avstämning", "checkin": "avstämning", "appraisal": "utvecklings", "development": "utvecklings",
    "talk": "samtal", "interview": "samtal", "planning": "planering", "meeting": "möte", "key": "nyckel", "keys": "nyckel", "receipt": "kvittens", "supply": "material",
    "supplies": "material", "order": "beställning", "timesheet": "tidrapportering", "time": "tid", "report": "rapport", "stock": "förråds", "count": "inventering",
    "inventory": "inventering", "sick": "sjuk", "call": "anmälan", "notice": "anmälan", "family": "anhörig", "relative": "anhörig", "vacation": "semesterdag", "holiday": "semesterdag",
    "parental": "föräldra", "leave": "ledig", "off": "inställt", "cancelled": "inställt", "called": "inställt", "blocked": "spärrad", "oncall": "jour", "standby": "beredskap",
    "duty": "jour",
    "städ": "städning", "städa": "städning", "tvätta": "tvätt", "hämta": "hämtning", "lämna": "lämning", "bilen": "bil", "första": "uppstart", "anmäld": "anmälan", "anmäla": "anmälan", "klotter": "graffiti",
    "stryka": "stryk", "kläder": "service", "bonvax": "vård", "vax": "vård", "bygge": "bygg", "beställa": "beställning", "rapportera": "rapportering", "inventera": "inventering", "rengöra": "rengöring", "kontoret": "kontor", "frysen": "frys",
    "golvet": "golv", "fönstret": "fönster", "trädgården": "trädgård", "hemmet": "hem", "skolan": "skol", "lagret": "lager",
}
#: Words that say nothing about a label.
FILLERS = set("för med av om på i till och vid enligt efter varje ta the a an of for to at in on out and some".split())
