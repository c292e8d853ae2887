"""Personal data replaced by keyed surrogates of the same type and format.

Detected entities (e-mail addresses, phone, card and identity numbers, IBANs, IP addresses, person
names) get surrogates computed from a secret key and the entity alone, so one entity has one
surrogate in the whole corpus. Numbers and addresses go through a keyed permutation of all
strings of their shape, which keeps letters letters and digits digits, and validity (check digits)
as it was, and maps no string to itself; digits of any script are read as numbers and written back in
their own script. Given names are permuted within their gender and script, family names become invented
ones of the same script; a name's parts are mapped one by one, so "Ms Lind" and "Karin Lind" still
agree, and a name found in full counts wherever its text repeats a part of it. Names are known by a title, an
address ("My name is") or a listed given name; an unlisted name with none of them is not found. A
corpus-wide check finds entities that share a surrogate or keep their own value and moves all
but the most frequent one on to the next draw.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.llm.common import pick, slices, stored

#: Redrawn surrogates up to this many are handed to every task; beyond it they are joined.
BROADCAST_ROWS = 20_000
MAX_DRAWS = 50
TYPES = ("email", "iban", "ip6", "ip", "ssn", "phone", "card", "given", "family", "initial")

# Given names by script and gender, and the syllables of invented family names: our own choice.
GIVEN = {
    ("latin", "m"): (
        "James John Robert Michael William Richard Thomas Peter Hans Klaus Wolfgang Pierre Jacques Michel Carlos "
        "Miguel Javier Andrew Aaron Abdul Abraham Adam Adrian Ahmed Alan Albert Alejandro Alex Alexander Alfred Ali "
        "Alfonso Alfredo Alberto Allan Allen Alvaro Anders Andre Andreas Andrzej Angelo Angus Anthony Anton Antonio "
        "Armando Arnold Arthur Arturo Axel Barry Bart Benedict Benjamin Bernard Bernd Björn Boris Brad Bradley "
        "Brandon Brendan Brent Brett Brian Bruce Bruno Bryan Callum Cameron Carl Carlo Cedric Charles Chris "
        "Christopher Christoph Christophe Claude Clifford Clive Colin Connor Conor Cornelius Craig Curtis Cyril "
        "Damian Damien Daniel Daniele Darren David Dean Dennis Derek Detlef Diego Dieter Dietmar Dirk Dmitri Dominic "
        "Dominik Donald Douglas Duncan Dustin Dylan Eamon Eberhard Edgar Eduardo Edmund Edward Edwin Elias Elijah "
        "Emanuel Emil Emilio Emmanuel Enrique Enzo Eric Erich Erik Ernest Ernesto Ernst Ethan Etienne Eugene Evan "
        "Fabian Fabio Federico Felipe Felix Fernando Filip Florian Francesco Francisco Franco François Franz Fred "
        "Frederic Frederick Fredrik Friedrich Fritz Gabriel Gareth Gary Gavin Geoffrey George Georg Georges Gerald "
        "Gerard Gerardo Gerhard Gert Gilbert Gilles Giorgio Giovanni Giulio Giuseppe Glenn Gonzalo Gordon Graham Greg "
        "Gregor Gregory Guido Guillaume Guillermo Günter Gustav Gustavo Guy Hamish Hannes Harald Harold Harry Hassan "
        "Hector Heinrich Heinz Helmut Hendrik Henri Henrik Henry Herbert Hermann Horst Howard Hubert Hugh Hugo "
        "Hussein Ian Ibrahim Ignacio Igor Isaac Ivan Jack Jacob Jaime Jakob Jamal Jan Jarek Jason Jean Jeff Jeffrey "
        "Jens Jeremy Jerome Jerry Jesse Jesus Jim Jimmy Joachim Joaquin Jochen Joe Joel Johan Johann Johannes Jonas "
        "Jonathan Jorge Jose José Josef Joseph Joshua Juan Julian Julien Julio Jürgen Justin Kai Karl Karsten Keith "
        "Kenneth Kenny Kevin Kurt Kyle Lachlan Lars Laurent Lawrence Leo Leon Leonard Leonardo Leroy Leslie Lewis "
        "Liam Logan Lorenzo Louis Luc Luca Lucas Luigi Luis Lukas Luke Magnus Malcolm Manfred Manuel Marc Marcel "
        "Marcin Marco Marcos Marcus Mario Marius Mark Markus Martin Mason Massimo Mateo Mathias Matteo Matthew "
        "Matthias Maurice Maurizio Mauro Max Maximilian Mehmet Michal Mike Mikael Mitchell Mohamed Mohammad Mohammed "
        "Muhammad Nathan Nathaniel Neil Nelson Nicholas Nicolas Niels Nigel Nikolai Nils Noah Norbert Norman Olaf Ole "
        "Oleg Oliver Olivier Omar Oscar Oskar Otto Owen Pablo Paolo Pascal Patrick Paul Pavel Pawel Pedro Per Phil "
        "Philip Philipp Philippe Phillip Pietro Piotr Rafael Raimund Rainer Ralf Ralph Ramon Randall Randy Raphael "
        "Raul Raymond Reginald Reinhard Rene Ricardo Riccardo Rick Ricky Robin Roberto Rodney Rodrigo Roger Roland "
        "Rolf Roman Ronald Ronnie Rory Ross Roy Rudolf Rupert Russell Ryan Salvatore Sam Samuel Sanjay Santiago Scott "
        "Sean Sebastian Sébastien Serge Sergei Sergio Seth Shane Shaun Shawn Siegfried Simon Stanley Stefan Stefano "
        "Stephan Stéphane Stephen Steve Steven Stewart Stuart Sven Ted Terence Terrence Terry Theo Theodore Thierry "
        "Thorsten Tim Timothy Tobias Todd Tom Tomas Tomasz Tommy Tony Torsten Travis Trevor Tristan Tyler Udo Uwe "
        "Victor Vincent Vincenzo Vladimir Volker Walter Warren Wayne Werner Wilhelm Willem Wojciech Xavier Yann "
        "Yannick Yusuf Yves Zachary Aarav Ajay Akira Amit Anil Arjun Ashok Bao Chidi Deepak Emeka Femi Haruto Hiroshi "
        "Jianguo Jiahao Kavi Kenji Kofi Kwame Mahesh Manoj Minh Mukesh Naveen Obinna Oluwaseun Praveen Rahul Rajesh "
        "Ramesh Ravi Rohan Sandeep Satoshi Suresh Takashi Tuan Vijay Vikram Weimin Xiaoming Yuto Zhiwei Wei").split(),
    ("latin", "f"): (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Karin Ursula Sabine Monika Nathalie Isabelle Camille "
        "Carmen Dolores Paula Margaret Abigail Adele Adriana Agnes Agnieszka Aisha Alejandra Alessandra Alexandra "
        "Alice Alicia Alison Allison Alyssa Amanda Amelia Amélie Amy Ana Andrea Angela Angelica Angelina Anita Anja "
        "Anke Ann Anna Anne Annette Annie Antje Antonia Ariana Ashley Astrid Audrey Aurélie Ava Barbra Beatrice "
        "Beatriz Becky Bella Bernadette Beth Bethany Betty Beverly Bianca Birgit Bonnie Brenda Bridget Brigitte "
        "Britta Brittany Brooke Carina Carla Carlotta Carol Carole Carolina Caroline Carolyn Catherine Cathy Cecilia "
        "Cécile Céline Chantal Charlotte Chelsea Cheryl Chiara Chloe Chloé Christa Christina Christine Cindy Claire "
        "Clara Clarissa Claudia Colette Colleen Connie Constance Cornelia Cristina Cynthia Dagmar Daniela Danielle "
        "Daphne Darlene Deborah Debra Denise Diana Diane Donna Dora Doris Dorothea Dorothy Edith Eileen Elaine "
        "Eleanor Elena Eleonora Elisa Elisabeth Elise Elke Ella Ellen Élodie Eloise Elsa Elsie Emilia Emily Emma "
        "Erica Erika Erin Esther Ethel Eugenia Eva Evelyn Fatima Federica Felicia Felicity Fiona Franca Frances "
        "Francesca Franziska Françoise Frieda Gabriela Gabriele Gabriella Gabrielle Gail Gemma Geneviève Geraldine "
        "Gertrud Gillian Gina Gisela Giulia Gloria Greta Gretchen Gudrun Gwen Hannah Harriet Hazel Heather Heidi "
        "Heike Helen Helena Helene Hélène Helga Henrietta Hilary Hilda Holly Ida Ilse Imogen Ines Inge Ingrid Irene "
        "Iris Irina Irma Isabel Isabella Isla Jacqueline Jana Jane Janet Janice Janine Jasmine Jeanette Jeanne Jenna "
        "Jennie Jenny Jessica Jill Joan Joanna Joanne Jocelyn Johanna Josephine Joyce Juana Judith Judy Julia Juliana "
        "Julie Juliet Jutta Kate Katarzyna Katharina Katherine Kathleen Kathryn Kathy Katia Katie Katja Katrin Kayla "
        "Kelly Kerstin Kim Kimberly Kirsten Klara Kristen Kristin Kristina Lara Laura Lauren Laurie Lena Leonie "
        "Leticia Lilian Lillian Lily Lisa Liv Lois Loretta Lorraine Louise Lucia Lucie Lucy Luisa Lydia Lynn "
        "Madeleine Madison Magdalena Małgorzata Manuela Marcia Margarita Margot Marguerite Maria María Mariana "
        "Marianne Marie Marina Marion Marisa Marjorie Marlene Marta Martha Martina Martine Matilda Maureen Maxine "
        "Megan Melanie Melinda Melissa Mercedes Meredith Mia Michaela Michele Michelle Mildred Miranda Miriam Molly "
        "Monica Monique Muriel Nadia Nadine Nancy Naomi Natalia Natalie Natasha Nicole Nina Noémie Nora Norma Olga "
        "Olivia Pamela Paola Patrizia Patty Paulina Pauline Peggy Penelope Petra Phoebe Phyllis Pilar Priscilla "
        "Rachel Raquel Rebecca Regina Renate Renée Rhonda Rita Roberta Rocio Rosa Rosalie Rosalind Rosario Rosemary "
        "Rosie Roxanne Ruth Sabrina Sally Samantha Sandra Sara Sarah Sharon Sheila Shirley Silke Silvia Simone Sofia "
        "Sonia Sonja Sophia Sophie Stacey Stacy Stefanie Stella Stephanie Susana Susanna Susanne Suzanne Svetlana "
        "Sylvia Sylvie Tamara Tania Tanya Tara Tatiana Teresa Teresita Tessa Theresa Tiffany Tina Tracey Tracy Ulrike "
        "Ursel Ute Valentina Valeria Valerie Vanessa Vera Veronica Veronika Véronique Vicky Victoria Viktoria Vivian "
        "Viviane Wanda Wendy Wilhelmina Winifred Xenia Yolanda Yvette Yvonne Zoe Zoë Adaeze Aiko Akiko Amara Ananya "
        "Anjali Ayesha Chiamaka Deepa Divya Folake Haruka Hui Kavita Keiko Lakshmi Linh Meera Mei Meiling Naoko Neha "
        "Ngozi Nneka Nisha Pooja Priya Priyanka Sakura Shreya Sunita Thandiwe Xiaoli Yan Yoko Yuki Zainab").split(),
    ("cyrillic", "m"): (
        "Иван Дмитрий Сергей Андрей Николай Павел Александр Алексей Анатолий Антон Артём Борис Вадим Валерий Василий "
        "Виктор Виталий Владимир Вячеслав Геннадий Георгий Григорий Даниил Денис Евгений Егор Игорь Илья Кирилл "
        "Константин Леонид Максим Михаил Никита Олег Пётр Роман Руслан Семён Станислав Степан Тимофей Фёдор Юрий "
        "Ярослав").split(),
    ("cyrillic", "f"): (
        "Анна Ольга Елена Мария Наталья Светлана Александра Алина Алиса Алла Анастасия Валентина Валерия Вера "
        "Вероника Виктория Галина Дарья Евгения Екатерина Жанна Зинаида Инна Ирина Кристина Ксения Лариса Людмила "
        "Маргарита Марина Надежда Нина Оксана Полина Раиса Софья Тамара Татьяна Юлия Яна").split(),
    ("greek", "m"): (
        "Γιώργος Δημήτρης Νίκος Κώστας Αλέξανδρος Ανδρέας Αντώνης Βασίλης Γεώργιος Γρηγόρης Δημήτριος Ηλίας Θανάσης "
        "Ιωάννης Κωνσταντίνος Λευτέρης Μανώλης Μιχάλης Νικόλαος Παναγιώτης Παύλος Πέτρος Σπύρος Στέλιος Σωτήρης "
        "Χρήστος Γιάννης").split(),
    ("greek", "f"): (
        "Μαρία Ελένη Κατερίνα Σοφία Αγγελική Αικατερίνη Αλεξάνδρα Αναστασία Άννα Βασιλική Γεωργία Δέσποινα Δήμητρα "
        "Ειρήνη Ευαγγελία Ζωή Ιωάννα Κωνσταντίνα Παναγιώτα Παρασκευή Χριστίνα Χρυσούλα").split(),
}
SYLLABLES = {
    "latin": [c + v for c in "bdfgklmnprstv" for v in ("a", "e", "i", "o", "u", "an", "er", "on")],
    "cyrillic": [c + v for c in "бвгдклмнпрст" for v in ("а", "е", "и", "о", "ов", "ин")],
    "greek": [c + v for c in "βγδκλμνπρστ" for v in ("α", "ε", "ι", "ο", "ου")],
    "arabic": [c + v for c in "بتدرزسفقكلمن" for v in ("ا", "و", "ي", "اد", "ان", "ير")],
    "han": list("文明华建国志伟强军平东海林春秋山川江河云雪梅兰竹菊芳丽娜静敏慧玲燕红玉珍秀英安宁康福瑞祥和"),
}
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Sir", "Dr", "Prof", "Professor", "Herr", "Frau", "Mme", "Mlle", "Monsieur",
          "Madame", "Señor", "Señora", "Sra", "Srta", "господин", "госпожа", "κύριος", "κυρία")
# Words that a person's name follows.
CUES = ("My name is", "my name is", "Dear", "Mein Name ist", "mein Name ist", "Me llamo", "me llamo", "Je m'appelle",
        "je m'appelle", "Меня зовут", "меня зовут")
PARTICLES = "de del della da di do dos du la las los le van von der den ter ten zu bin ibn bint al el".split()
# Capitalised words that follow a name without being part of it, and those behind a cue that name nobody.
NOT_NAMES = frozenset((
    "The This That These Those There Then And But Or Not In On At To From Of For By With As If When While After Before "
    "He She It We They You His Her Our Their Its Is Was Are Were Has Had Will Would Can Could May Said Says "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August "
    "September October November December University College School Institute Street Road Avenue Hospital Company "
    "Corporation Foundation Museum Airport Bank Hotel Award Prize Inc Ltd Corp GmbH "
    "Sir Madam Madame Customer Customers Colleague Colleagues Friend Friends All Team Reader Readers Editor Editors "
    "Mom Dad Mother Father Lord God Santa Diary Valued Member Members Students Parents Hiring Manager").split())
# Given names that are words of other use: in capitals alone they start no name.
WORDS_TOO = frozenset(("Max Mark Guy Kim Per Ole Roman Dean Dora Drew Grace Iris Jasmine Joy Hazel Holly Ida Ava Mason "
                       "Victor Bella Mercedes Rosario Luc Liv Mia Jack Rick Rob Will Bill Art Ray Rose Ruby Lily Molly "
                       "Dolores Pilar Paris Yan Bao Mei Hui Wei Angel Gene Earl Norm Cliff Ana Eva Ann Ian Don").split())

_GENDER = {name: key for key, names in GIVEN.items() for name in names}
# Spellings of given names, as written and in capitals, with the name itself.
_SPELT = {name.upper(): name for name in _GENDER if len(name) > 2 and name not in WORDS_TOO} | {n: n for n in _GENDER}
_CAP = r"[A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁΆΈ-ΏΑ-Ω][A-Za-zÀ-ÖØ-öø-žА-Яа-яЁёΆΈ-ώ'’-]{1,30}"
_INITIAL = r"[A-ZА-Я]\.(?:-?[A-ZА-Я]\.)*"
_PARTICLE = rf"(?:(?:{'|'.join(PARTICLES)})\x20){{1,3}}"
_TITLE = rf"(?:{'|'.join(map(re.escape, TITLES))})\.?\x20"
# A title (or several) or a cue or a given name, and the words that may belong to the name.
NAME = re.compile(
    rf"(?<!\w)(?:(?P<title>(?:(?:{'|'.join(CUES)})\x20)?(?:{_TITLE})+(?:{_PARTICLE})?)"
    rf"|(?P<cue>(?:{'|'.join(CUES)})\x20)|(?={'|'.join(_SPELT)}))"
    rf"(?P<name>(?:{_INITIAL}\x20?){{0,3}}{_CAP}(?:\x20(?:{_PARTICLE})?(?:{_INITIAL}|{_CAP})){{0,6}})(?!\w)")
WORD = re.compile(rf"{_INITIAL}|{_CAP}|[^\W\d_]+")
LONE = re.compile(r"[^\W\d_][^\W\d_'’-]*(?:['’-][^\W\d_]+)*")
_OWNER = re.compile(r"(?:['’][sS]?|-)$")
# Scripts without capitals: a form of address beside the name says what it is.
ADDRESSED = re.compile(
    r"(?<!\w)(?:السيدة|السيد|الدكتورة|الدكتور|الأستاذة|الأستاذ)\x20(?P<ar>[\u0621-\u064A]{2,20}(?:\x20[\u0621-\u064A]{2,20})?)(?!\w)"
    r"|(?P<han>[王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许邓韩冯曹彭曾萧田董潘袁蔡蒋余于杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石]"
    r"[\u4E00-\u9FFF]{1,2})(?=先生|女士|小姐|教授|医生|博士|老师)")
_NO_CAPITALS = re.compile(r"(?:السيد|الدكتور|الأستاذ)|(?:先生|女士|小姐|教授|医生|博士|老师)")
# Where a title, a cue or a given name starts: by first letter, so that a text is skipped at the speed of a
# character set.
_STARTS = {}
for _word in (*TITLES, *CUES, *_SPELT):
    _STARTS.setdefault(_word[0], []).append(_word[1:])
START = re.compile("|".join(rf"{c}(?<!\w{c})(?:{'|'.join(rest)})(?=\.?\x20)" for c, rest in _STARTS.items()))
# Alphabets whose letters a surrogate of an address replaces, each among themselves: first letter, size.
ALPHABETS = {"a": 26, "A": 26, "à": 23, "ø": 7, "а": 32, "α": 25}
_MAIL = "A-Za-zÀ-ÖØ-Þà-öø-þА-Яа-яΑ-ΡΣ-Ωα-ω"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
MARKED = re.compile("|".join((
    rf"(?P<email>(?<![\w.%+-])[{_MAIL}0-9._%+-]{{1,64}}@(?:[{_MAIL}0-9-]{{1,63}}\.){{1,8}}[{_MAIL}]{{2,24}}(?![{_MAIL}]))",
    r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w))",
    rf"(?P<ip6>(?<!\w)(?<![0-9A-Fa-f:]:)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{6}}{_V4}"
    rf"|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:(?:{_HEX}:){{0,5}}{_V4}|{_HEX}(?::{_HEX}){{0,6}})?)(?!\w|:[\w:]|\.\d))",
    rf"(?P<ip>(?<![\w.]){_V4}(?!\w|\.\d))",
    r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
    r"(?P<phone>(?<![\w+])(?:\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d{2,4}(?:[\x20.-]\d{2,4}){1,4}"
    r"|\(\d{3}\)\x20?\d{3}[-.\x20]\d{4}|\d{3}([-.\x20])\d{3}\7\d{4})(?!\w))",
    r"(?P<card>(?<![\w.-])[3-6]\d{3}(?:[\x20-]?\d{4}){3}(?:\d{1,3})?(?![\w-]))",
    r"(?P<card15>(?<![\w.-])3[47]\d{2}[\x20-]?\d{6}[\x20-]?\d{5}(?![\w-]))")))


_MARK = re.compile(r"[@\d]|::")
_OTHER_DIGIT = re.compile(r"[^\D0-9]")


def zero(c: str) -> int:
    """Code point of the zero in the script of a decimal digit; -1 for other characters."""
    d = unicodedata.decimal(c, -1)
    return ord(c) - d if d >= 0 else -1


def plain(text: str) -> str:
    """``text`` with the decimal digits of all scripts as ASCII digits."""
    return text if text.isascii() else _OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_check(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


# Lengths of the IBANs of the countries that have them.
IBAN_LENGTH = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 "
    "FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 "
    "LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 "
    "RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}


def iban_in(got: str) -> tuple[str, int] | None:
    """(IBAN, characters of ``got`` it takes): up to a space of ``got`` or to its end, the country's length first.

    Of a country without a listed length the longest one that passes the check."""
    known = IBAN_LENGTH.get(got[:2])
    ends = [*(i for i, c in enumerate(got) if c == " "), len(got)][::-1]
    values = [(got[:end].replace(" ", ""), end) for end in ends]
    if known:
        values = [x for x in values if len(x[0]) == known] + values[:1]
    return next(((v, end) for v, end in values if 15 <= len(v) <= 34 and iban_check(v) == 1), None)


def ip6_in(got: str) -> str | None:
    """The address as eight groups of four digits; None where no host can have it.

    Compressed spellings also occur in source code (``[::2]``, ``a::b``), so these count only within the space
    that is assigned at all, with a dotted quad, or as the loopback address.
    """
    try:
        address = ipaddress.IPv6Address(got)
    except ValueError:
        return None
    if "::" in got and "." not in got and address.is_reserved and not (
            address.is_loopback or address.ipv4_mapped or address in _NAT64):
        return None
    text = f"{int(address):032x}"
    return ":".join(text[i:i + 4] for i in range(0, 32, 4))


_NAT64 = ipaddress.IPv6Network("64:ff9b::/96")


def script_of(word: str) -> str:
    first = next((c for c in word if c.isalpha()), "a")
    for name, low, high in (("cyrillic", "Ѐ", "ӿ"), ("greek", "Ͱ", "Ͽ"), ("arabic", "\u0600", "\u06ff"),
                            ("han", "\u4e00", "\u9fff")):
        if low <= first <= high:
            return name
    return "latin"


def letter(c: str) -> tuple[int, int]:
    """(code point of the first letter, size) of the alphabet of ``c``; (-1, 0) for what is in none."""
    if c.isascii():
        first = "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else ""
        return (ord(first), 26) if first else (-1, 0)
    return next(((ord(f), n) for f, n in ALPHABETS.items() if ord(f) <= ord(c) < ord(f) + n), (-1, 0))


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical) of the entities of a text, in order, not overlapping."""
    out = []
    if _MARK.search(text):
        flat, at = plain(text), 0
        while m := MARKED.search(flat, at):
            kind = "card" if m.lastgroup == "card15" else m.lastgroup
            got, end = m.group(), m.end()
            if kind == "iban":
                value, used = iban_in(got) or (None, 0)
                end = m.start() + used
            elif kind == "ip6":
                value = ip6_in(got)
            elif kind in ("card", "ssn", "phone"):
                value = "".join(c for c in got if c.isdigit())
                if kind == "phone" and not 7 <= len(value) <= 15:
                    value = None
            else:
                value = got.lower() if kind == "email" else got
            if value is None:  # what a failed match took may hold another entity
                at = m.start() + 1
                continue
            out.append((m.start(), end, kind, value))
            at = end
    names = people(text, out)
    if names:
        out = sorted(out + names)
    return out


def name_parts(m: re.Match) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical) of the words of one match of ``NAME`` that are part of the name.

    Initials and listed given names come first, then at most two family names; particles between them
    stay. A name without a title starts with a listed given name and needs one more word; in a name that starts in capitals all
    parts are in capitals.
    """
    out, families, base, titled = [], 0, m.start("name"), bool(m["title"] or m["cue"])
    known = False
    for w in WORD.finditer(m["name"]):
        word = w[0]
        if word in PARTICLES:
            continue
        if word[-1] == ".":
            if families:
                break
            out += [(base + w.start() + i, base + w.start() + i + 1, "initial", c.lower())
                    for i, c in enumerate(word) if c.isalpha()]
            continue
        plain_word = _OWNER.sub("", word)
        if plain_word in NOT_NAMES or plain_word in TITLES or len(plain_word) < 2:
            break
        if out and not titled and m["name"].split(" ", 1)[0].isupper() and not plain_word.isupper():
            break
        span = (base + w.start(), base + w.start() + len(plain_word))
        given = _SPELT.get(plain_word)
        last = plain_word != word
        if given and not families and not (last and known):
            out.append((*span, "given", given))
            known = True
        else:
            out.append((*span, "family", plain_word.lower()))
            families += 1
        if last or families == 2:
            break
    words = [x for x in out if x[2] != "initial"]
    if words and not families and (len(words) > 1 or m["title"]):  # "Mr James", "Mary Rose": the last name is a family's
        k = out.index(words[-1])
        out[k] = (*out[k][:2], "family", m.string[out[k][0]:out[k][1]].lower())
        families = 1
    return out if words and (titled or families) else []


def people(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The names in a text outside the spans of ``taken`` (in order).

    A given or family name found in full counts wherever the text repeats it by itself with a capital, unless the text
    also has it as a common word in small letters.
    """
    found, at = [], 0
    while start := START.search(text, at):
        m = NAME.match(text, start.start())
        parts = name_parts(m) if m else []
        found += parts
        at = parts[-1][1] if parts else start.end()
    if _NO_CAPITALS.search(text):
        for m in ADDRESSED.finditer(text):
            at = m.start(m.lastgroup)
            for part in m[m.lastgroup].split(" "):
                found.append((at, at + len(part), "family", part))
                at += len(part) + 1
    if not found:
        return []
    known = {}
    for a, b, kind, value in found:
        if kind != "initial" and b - a > 2:
            for spelt in (text[a:b], text[a:b].title(), text[a:b].upper()):
                if spelt.isupper() and value in WORDS_TOO and not text[a:b].isupper():
                    continue
                if known.get(spelt, ("",))[0] != "given":
                    known[spelt] = (kind, value)
    blocked = sorted(taken + found)
    small, lone, k = set(), [], 0
    for m in LONE.finditer(text):
        while k < len(blocked) and blocked[k][1] <= m.start():
            k += 1
        if k < len(blocked) and blocked[k][0] < m.end():
            continue
        word = _OWNER.sub("", m[0])
        if word in known:
            lone.append((m.start(), m.start() + len(word), *known[word]))
        elif word.islower():
            small.add(word)
    lone = [x for x in lone if script_of(text[x[0]:x[1]]) in ("arabic", "han") or text[x[0]:x[1]].lower() not in small]
    out, k = [], 0
    for x in sorted(found):
        while k < len(taken) and taken[k][1] <= x[0]:
            k += 1
        if (k == len(taken) or x[1] <= taken[k][0]) and (not out or out[-1][1] <= x[0]):
            out.append(x)
    return out + lone


class Surrogates:
    """Keyed surrogates: ``of(type, canonical, draw)`` depends on nothing else."""

    def __init__(self, key: bytes):
        self.key = key
        self.of = functools.lru_cache(maxsize=50_000)(self._of)
        self.cycle = functools.lru_cache(maxsize=64)(self._cycle)

    def _number(self, *parts) -> int:
        return int.from_bytes(hmac.new(self.key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")

    def permute(self, values: list[int], sizes: list[int], tweak: str) -> list[int]:
        """A keyed permutation without fixed points of all digit lists with these radices.

        An unbalanced Feistel network, a step to the next of all lists, and the network backwards: one
        cycle through all lists, so a list never keeps its value, however few there are.
        """
        if len(values) == 1:
            return [(values[0] + 1 + self._number(tweak) % max(1, sizes[0] - 1)) % sizes[0]]
        half = len(values) // 2

        def join(v, r):
            n = 0
            for a, b in zip(v, r, strict=True):
                n = n * b + a
            return n

        left, right = join(values[:half], sizes[:half]), join(values[half:], sizes[half:])
        a = b = 1
        for r in sizes[:half]:
            a *= r
        for r in sizes[half:]:
            b *= r
        for turn in range(10):
            if turn % 2:
                right = (right + self._number(tweak, turn, left)) % b
            else:
                left = (left + self._number(tweak, turn, right)) % a
        left, right = divmod((left * b + right + 1) % (a * b), b)
        for turn in reversed(range(10)):
            if turn % 2:
                right = (right - self._number(tweak, turn, left)) % b
            else:
                left = (left - self._number(tweak, turn, right)) % a
        out = []
        for n, radices in ((left, sizes[:half]), (right, sizes[half:])):
            part = []
            for r in reversed(radices):
                n, d = divmod(n, r)
                part.append(d)
            out += reversed(part)
        return out

    def shaped(self, text: str, tweak: str, keep: set[int] = frozenset()) -> str:
        """Permute the letters of ``ALPHABETS`` and all decimal digits of ``text``, each within its alphabet, among
        strings of its shape; ``keep`` stays."""
        at, values, sizes, first = [], [], [], []
        for i, c in enumerate(text):
            base, size = letter(c)
            if base < 0:
                base, size = zero(c), 10
            if base >= 0 and i not in keep:
                at.append(i)
                first.append(base)
                sizes.append(size)
                values.append(ord(c) - base)
        if not at:
            return text
        out = list(text)
        fixed = "".join(c if i in keep or not c.isalnum() else "#" for i, c in enumerate(text))
        for i, b, v in zip(at, first, self.permute(values, sizes, f"{tweak}|{fixed}|{sizes}"), strict=True):
            out[i] = chr(b + v)
        return "".join(out)

    def _cycle(self, group: tuple[str, str], draw: int) -> dict[str, str]:
        """Each given name of a script and gender with the one that takes its place."""
        order = sorted(GIVEN[group], key=lambda n: self._number("given", draw, n))
        return dict(zip(order, order[1:] + order[:1], strict=True))

    def _of(self, kind: str, value: str, draw: int) -> str:
        tweak = f"{kind}|{draw}"
        if kind == "email":
            end = value.rindex(".")
            keep = range(end, len(value)) if any(c.isalnum() for c in value[:end]) else ()
            return self.shaped(value, tweak, set(keep))  # the last label moves where nothing else can
        if kind == "ip":
            return ".".join(map(str, self.permute([int(x) for x in value.split(".")], [256] * 4, tweak)))
        if kind == "ip6":
            digits = self.permute([int(c, 16) for c in value if c != ":"], [16] * 32, tweak)
            text = "".join(f"{d:x}" for d in digits)
            return ":".join(text[i:i + 4] for i in range(0, 32, 4))
        if kind == "iban":
            body = self.shaped(value[4:], tweak + value[:2])
            return f"{value[:2]}{98 - iban_check(value[:2] + '00' + body):02d}{body}"
        if kind == "card":
            if luhn(value):
                body = self.shaped(value[:-1], tweak, {0})
                return next(body + c for c in "0123456789" if luhn(body + c))
            out = self.shaped(value, tweak, {0})
            while luhn(out):  # walk on within the numbers that fail the check as the original does
                out = self.shaped(out, tweak, {0})
            return out
        if kind == "phone":
            return self.shaped(value, tweak, set(range(max(0, len(value) - 10))))
        if kind == "given":
            return self.cycle(_GENDER[value], draw)[value]
        if kind == "family":
            script = script_of(value)
            parts = SYLLABLES[script]
            n = self._number(tweak, value)
            word = ""
            size = min(5, max(2, round(len(value) / 2.5))) + draw // 3
            while size > 0 or (n and draw >= MAX_DRAWS - 2):  # the last draws spell out the whole number
                size -= 1
                n, k = divmod(n, len(parts))
                word += parts[k]
            return word
        return self.shaped(value, tweak)

    @staticmethod
    def fit(kind: str, original: str, surrogate: str) -> str:
        """A surrogate in the punctuation and case of one occurrence."""
        if kind == "ip":
            base = max(map(zero, original))
            return "".join(chr(base + int(c)) if c.isdigit() else c for c in surrogate)
        if kind == "ip6":
            return surrogate
        if kind in ("given", "family"):
            if original.isupper() and len(original) > 2:
                return surrogate.upper()
            return surrogate if kind == "given" else surrogate.capitalize()
        source = iter(c for c in surrogate if c.isalnum())
        out = []
        for c in original:
            if c.isalnum():
                s = next(source)
                c = s.upper() if c.isupper() else chr(zero(c) + int(s)) if s.isdigit() and not c.isascii() else s
            out.append(c)
        return "".join(out)


@functools.lru_cache(maxsize=4)
def surrogates(key: bytes) -> Surrogates:
    return Surrogates(key)


ENTITY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])


def entities(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, kind, value): the distinct entities of each text."""
    rows = pick(docs, key, text).filter(F.col(text).isNotNull()).select(
        key, F.xxhash64(text).alias("text_hash"), text)
    schema = T.StructType([rows.schema[0], rows.schema[1], *ENTITY.fields])

    def run(batches):
        for batch in slices(batches):
            at, kinds, values = [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                for kind, value in dict.fromkeys((k, v) for _, _, k, v in find(t)):
                    at.append(i)
                    kinds.append(kind)
                    values.append(value)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(
                kinds, pa.string()), pa.array(values, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def draw_surrogates(found: DataFrame, secret: bytes) -> DataFrame:
    """(kind, value, n, draw): the draw at which every entity has a surrogate of its own.

    Within a kind no two entities share a surrogate and none keeps its value; in a clash the most
    frequent entity stays and the others take the next draw. Numbers, addresses and given names are permuted
    without fixed points and do not clash at draw 0; invented family names can, and grow with the draw up to
    the whole keyed hash. Each round moves only the narrow entity table, pre-aggregated; a draw of 0 for
    all, the usual end, takes one round.
    """
    every = stored(found.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "draw", F.lit(0)), "pii-entities")
    schema = T.StructType([*every.schema.fields, T.StructField("surrogate", T.StringType())])

    def run(batches):
        own = surrogates(secret)
        for batch in batches:
            got = [own.of(k, v, d) for k, v, d in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=schema.names)

    for _ in range(MAX_DRAWS):
        drawn = stored(every.mapInArrow(run, schema), "pii-drawn")
        keepers = drawn.filter("surrogate <> value").groupBy("kind", "surrogate").agg(
            F.max(F.struct("n", "value"))["value"].alias("keeper"))
        judged = drawn.join(keepers, ["kind", "surrogate"], "left").withColumn(
            "moves", ~F.col("value").eqNullSafe(F.col("keeper")))
        if judged.filter("moves").isEmpty():
            return drawn.drop("surrogate")
        every = stored(judged.select("kind", "value", "n", (F.col("draw") + F.col("moves").cast("int")).alias("draw")),
                       "pii-entities")
    raise ValueError(f"entities still share surrogates after {MAX_DRAWS} draws")


def replace(docs: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text",
            broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with all its columns and rows, the personal data in ``text`` replaced, and ``pii_counts``
    (a map of entity kind to occurrences).

    One entity has one surrogate in all rows, other entities have others. NULL and empty texts stay as they
    are; repeated rows are replaced alike; an empty table gives an empty result; a column of the input
    named pii_counts is kept and the counts come last. Very long texts are searched whole, in time that grows with
    their length; one text at a time is searched. Texts are read twice and not shuffled, unless
    more than ``broadcast_rows`` entities needed another draw: then the texts that hold one are
    joined with their draws.
    """
    found = stored(entities(docs, key, text), "pii-found")
    moved = draw_surrogates(found, secret).filter("draw > 0")
    names = docs.columns
    at_key, at_text = names.index(key), names.index(text)
    rows = docs.toDF(*[f"_{i}" for i in range(len(names))])
    fixed: dict[tuple[str, str], int] = {}
    if moved.count() <= broadcast_rows:
        fixed = {(r["kind"], r["value"]): r["draw"] for r in moved.collect()}
        rows = rows.withColumn("_draws", F.lit(None).cast("array<struct<kind:string,value:string,draw:int>>"))
    else:
        per_text = found.join(moved, ["kind", "value"]).groupBy(F.col(key).alias("k"), "text_hash").agg(
            F.collect_set(F.struct("kind", "value", "draw")).alias("_draws"))
        rows = rows.withColumn("_hash", F.xxhash64(f"_{at_text}"))
        rows = rows.join(per_text, F.col(f"_{at_key}").eqNullSafe(F.col("k")) & (
            F.col("_hash") == F.col("text_hash")), "left").drop("_hash", "k", "text_hash")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("_n", T.MapType(T.StringType(), T.IntegerType()))])

    def run(batches):
        own = surrogates(secret)
        for batch in slices(batches):
            texts, counts = [], []
            for t, draws in zip(batch.column(at_text).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                drawn = {(d["kind"], d["value"]): d["draw"] for d in draws} if draws else fixed
                parts, end, n = [], 0, {}
                for a, b, kind, value in find(t) if t else ():
                    parts += [t[end:a], own.fit(kind, t[a:b], own.of(kind, value, drawn.get((kind, value), 0)))]
                    end, n[kind] = b, n.get(kind, 0) + 1
                texts.append("".join(parts) + t[end:] if parts else t)
                counts.append(list(n.items()))
            columns = batch.columns[:-1]
            columns[at_text] = pa.array(texts, pa.string())
            columns.append(pa.array(counts, pa.map_(pa.string(), pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*names, "pii_counts")
