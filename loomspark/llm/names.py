"""Given names by script and gender, titles, endings of surnames and letters, for detecting and replacing personal names."""

_LISTED: dict[tuple[str, str], tuple[str, ...]] = {
    ("latin", "m"): tuple("""James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew Kenneth Kevin Brian
    George Edward Ronald Jürgen Klaus Wolfgang Stefan Günter François Jacques Philippe Thierry Laurent José Carlos Miguel Javier Alejandro
    John Paul Donald Joshua Timothy Jason Jeffrey Gary Ryan Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory
    Alexander Patrick Raymond Dennis Jerry Tyler Aaron Adam Henry Nathan Zachary Peter Kyle Walter Ethan Jeremy Harold Keith Christian Roger
    Gerald Carl Terry Arthur Lawrence Albert Joe Bruce Ralph Eugene Russell Philip Louis Bobby Johnny Oliver Simon Graham Nigel Alan Colin Ian Stuart
    Boris Ivan Igor Oleg Dmitri Vladimir Sergei Mikhail Nikolai Alexei Pavel Yuri Viktor Konstantin Anatoly Leonid Vasily Grigory
    Hans Peter Uwe Horst Manfred Dieter Helmut Werner Gerhard Rainer Matthias Andreas Sebastian Tobias Florian Jens Lars Sven Kurt Heinrich Friedrich Otto Karl Ludwig
    Pierre Jean Michel André Bernard Alain Marcel Henri Luc Yves Olivier Antoine Guillaume Mathieu Pascal Didier Gérard René Christophe Éric Étienne
    Juan Antonio Manuel Francisco Luis Pedro Jorge Fernando Diego Pablo Sergio Rafael Ricardo Eduardo Roberto Andrés Raúl Álvaro Enrique Alberto Ramón Gonzalo
    Giovanni Giuseppe Marco Luca Matteo Alessandro Francesco Lorenzo Paolo Stefano Mario João Tiago Rui Nuno Mateusz Piotr Krzysztof Tomasz Wojciech Jan Jakub Petr
    Ahmed Mohammed Ali Omar Hassan Ibrahim Yusuf Khalid Raj Arjun Rahul Vijay Sanjay Amit Hiroshi Kenji Takashi Wei Jun Minh""".split()),
    ("latin", "f"): tuple("""Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Margaret Nancy Betty Sandra Ashley Kimberly Emily Michelle Carol Amanda
    Melissa Deborah Ursula Monika Brigitte Heike Gisela Céline Nathalie Isabelle Sylvie Aurélie Carmen Pilar Lucía Mercedes Guadalupe
    Sarah Karen Lisa Donna Dorothy Stephanie Rebecca Sharon Laura Cynthia Kathleen Amy Angela Shirley Anna Brenda Pamela Emma Nicole Helen Samantha Katherine
    Christine Debra Rachel Carolyn Janet Catherine Maria Heather Diane Ruth Julie Olivia Joyce Virginia Victoria Kelly Lauren Christina Joan Evelyn Judith Megan Andrea
    Cheryl Hannah Jacqueline Martha Gloria Teresa Ann Sara Madison Frances Kathryn Janice Jean-Marie Abigail Alice Julia Judy Sophia Denise Amber Doris Marilyn Danielle
    Ivanka Natasha Olga Tatiana Irina Svetlana Ludmila Galina Yulia Ekaterina Elena Natalia Anastasia Ksenia Oksana Larisa Nadezhda Lyudmila
    Sabine Petra Claudia Susanne Birgit Gabriele Karin Renate Ingrid Helga Anja Katrin Silke Ute Elke Angelika Christa Erika Hildegard Gertrud
    Marie Monique Françoise Catherine Sophie Camille Chloé Manon Léa Élodie Valérie Véronique Brigitte Hélène Jeanne Simone Geneviève Odile Agnès
    Ana María Isabel Dolores Teresa Rosa Cristina Marta Elena Paula Beatriz Silvia Sofía Alba Inés Rocío Lourdes Montserrat Yolanda Ximena
    Giulia Francesca Chiara Alessandra Valentina Federica Mariana Joana Inês Beata Agnieszka Katarzyna Małgorzata Ewa Zofia Jana Lenka
    Fatima Aisha Maryam Layla Priya Anjali Deepa Sunita Yuki Sakura Keiko Mei Linh""".split()),
    ("cyrillic", "m"): tuple("Александр Дмитрий Максим Сергей Андрей Алексей Иван Михаил Николай Владимир Павел Юрий Борис Виктор Игорь Олег Константин Евгений Анатолий Леонид Василий Григорий Роман Артём Никита Егор Кирилл Пётр Степан Фёдор".split()),
    ("cyrillic", "f"): tuple("Анна Мария Елена Ольга Наталья Екатерина Татьяна Ирина Светлана Людмила Галина Юлия Анастасия Ксения Оксана Лариса Нина Валентина Дарья Полина Алина Марина Зоя Раиса Тамара".split()),
    ("greek", "m"): tuple("Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παναγιώτης Χρήστος Βασίλης Μιχάλης Αλέξανδρος Θανάσης Σπύρος Στέλιος Ανδρέας".split()),
    ("greek", "f"): tuple("Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα Ιωάννα Ειρήνη Αναστασία Παναγιώτα Ευαγγελία Χριστίνα".split()),
}
_SIDE = {n: side for side, pool in reversed(_LISTED.items()) for n in pool}
#: Each given name once, in one pool.
GIVEN = {side: tuple(n for n in dict.fromkeys(pool) if _SIDE[n] == side) for side, pool in _LISTED.items()}
#: A title settles the gender where the given name isn't known; '' where it doesn't.
TITLES: dict[str, str] = {
    "Mr": "m", "Mister": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mademoiselle": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f",
    "Dr": "", "Doctor": "", "Prof": "", "Professor": "", "Sir": "m", "Dame": "f", "Doktor": "", "Docteur": "", "Professeur": "", "Dra": "f", "Doña": "f", "доктор": "", "профессор": "", "Г-н": "m", "Г-жа": "f", "Δρ": "",
}
#: Endings that tell a surname, and mostly its gender; a surrogate keeps them.
ENDINGS = ("skaya", "skaia", "opoulou", "opoulos", "enko", "wicz", "vich", "vić", "ova", "eva", "sky", "ski", "ska", "sson", "sdóttir", "ская", "ский", "енко", "ова", "ева", "ов", "ев", "όπουλος", "οπούλου", "ίδης", "ίδου", "άκης", "άκη")
VOWELS = {"latin": "aeiouyäöüáéíóúàèìòùâêîôûëïœæøå", "cyrillic": "аеёиоуыэюя", "greek": "αεηιουωάέήίόύώ"}
LETTERS = {"latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"), "cyrillic": ("аеиоу", "бвгджзклмнпрстфхцчшщ"), "greek": ("αειου", "βγδζθκλμνξπρστφχψ")}
#: Words that begin a sentence and aren't a given name before a known surname.
OPENERS = frozenset("""The A An And But Or Nor So Yet When While Where Who What Why How As If In On At For To Of By With From After Before Then There Here He She It They We You I His Her Their
Our My Your Its This That These Those Said Says Yes No Not Dear Hello Hi Thanks Both Also Even Only Today Yesterday Tomorrow Later Soon Now Once Since Until Because Although Though However
Der Die Das Ein Eine Und Aber Oder Als Wenn Wo Wer Was Warum Wie Im In Am An Für Zu Von Mit Nach Dann Er Sie Es Wir Ihr Ich Sein Dieser Diese Le La Les Un Une Et Mais Ou Quand Où Qui Que
Il Elle Ils Nous Vous Je Son Sa Ses Ce Cette El Los Las Una Y Pero O Cuando Donde Quien Su Este Esta Él Ella Yo""".split())
