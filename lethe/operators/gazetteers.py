"""Gazetteers of names that are kept."""

# Fixed values, in their order; results depend on every entry.

DOU = (
    "Α' Αθηνών",
    "Β' Αθηνών",
    "Γ' Αθηνών",
    "Δ' Αθηνών",
    "Ε' Αθηνών",
    "ΣΤ' Αθηνών",
    "Ζ' Αθηνών",
    "Η' Αθηνών",
    "Θ' Αθηνών",
    "Ι' Αθηνών",
    "ΙΑ' Αθηνών",
    "ΙΒ' Αθηνών",
    'Αμαρουσίου',
    'Γλυφάδας',
    'Ηλιούπολης',
    'Ιλίου',
    'Καλλιθέας',
    'Κηφισιάς',
    'Μαρούσι',
    'Νέας Ιωνίας',
    'Νέου Ψυχικού',
    'Παλλήνης',
    "Πειραιώς Α'",
    "Πειραιώς Β'",
    'Πατρών',
    "Θεσσαλονίκης Α'",
    "Θεσσαλονίκης Β'",
    "Θεσσαλονίκης Γ'",
    "Θεσσαλονίκης Δ'",
    "Ηρακλείου Α'",
    "Ηρακλείου Β'",
    "Λάρισας Α'",
    "Λάρισας Β'",
    'Βόλου',
    'Ιωαννίνων',
    'Καβάλας',
    'Κομοτηνής',
    'Τρικάλων',
    'Λαμίας',
    'Χαλκίδας',
    'Ρόδου',
    'Κέρκυρας',
    'Χανίων',
    'Ρεθύμνης',
    'Αγρινίου',
    'Σπάρτης',
    'Τρίπολης',
    'Καλαμάτας',
    'Κορίνθου',
    'Ναυπλίου',
    'Χαλανδρίου',
    'Μεσολογγίου',
    'Μυτιλήνης',
    'Σάμου',
    'Χίου',
    'Σύρου',
)

PUBLIC_SERVICES = (
    'ΑΑΔΕ',
    'Ανεξάρτητη Αρχή Δημοσίων Εσόδων',
    'Υπουργείο Οικονομικών',
    'Υπουργείο Δικαιοσύνης',
    'Υπουργείο Εσωτερικών',
    'Υπουργείο Παιδείας',
    'Υπουργείο Υγείας',
    'Υπουργείο Εργασίας',
    'Υπουργείο Ανάπτυξης',
    'Υπουργείο Περιβάλλοντος',
    'Υπουργείο Υποδομών',
    'Υπουργείο Αγροτικής Ανάπτυξης',
    'Υπουργείο Πολιτισμού',
    'Υπουργείο Τουρισμού',
    'Υπουργείο Μεταναστευτικής Πολιτικής',
    'Γενική Γραμματεία Πληροφοριακών Συστημάτων',
    'ΕΦΚΑ',
    'ΙΚΑ',
    'ΟΑΕΕ',
    'ΤΕΒΕ',
    'ΟΓΑ',
    'ΟΑΕΔ',
    'ΕΟΠΥΥ',
    'ΕΟΦ',
    'ΕΟΤ',
    'ΕΛΣΤΑΤ',
    'Ελεγκτικό Συνέδριο',
    'Νομικό Συμβούλιο του Κράτους',
    'Άρειος Πάγος',
    'Εφετείο',
    'Πρωτοδικείο',
    'Ειρηνοδικείο',
    'Διοικητικό Εφετείο',
    'Διοικητικό Πρωτοδικείο',
    'Συμβούλιο της Επικρατείας',
    'Δήμος',
    'Περιφέρεια',
    'Αποκεντρωμένη Διοίκηση',
    'ΑΣΕΠ',
    'ΣΔΟΕ',
    'ΥΠΕΕ',
    'Δικαστήριο',
    'Α.Α.Δ.Ε.',
    'ΑAΔΕ',
    'Δ.Ε.Δ.',
    'ΔΕΔ',
    'Κ.Ε.ΜΕ.Φ.',
    'Κ.Ε.ΦΟ.ΜΕ.Π.',
    'Υ.Ε.Δ.Δ.Ε.',
    'ΕΛ.ΚΕ.',
    'ΣτΕ',
    'ΝΣΚ',
    'ΥΠΑΑΤ',
)

LEGAL_REFS = (
    'Ν.',
    'ν.',
    'νόμος',
    'Π.Δ.',
    'π.δ.',
    'Κ.Φ.Δ.',
    'Κ.Ν.',
    'Α.Ν.',
    'Κ.Φ.Ε.',
    'Κ.Β.Σ.',
    'Κ.Ε.Δ.Ε.',
    'ΚΦΔ',
    'ΚΦΕ',
    'άρθρο',
    'άρθρου',
    'άρ.',
    'παρ.',
    'παράγραφος',
    'παράγραφο',
    'εδάφιο',
    'περ.',
    'περίπτωση',
    'υποπερ.',
    'υποπαράγραφος',
    'τμήμα',
    'κεφάλαιο',
)

REGIONS = (
    'Αττικής',
    'Αττική',
    'Θεσσαλονίκης',
    'Θεσσαλονίκη',
    'Στερεάς Ελλάδας',
    'Κεντρικής Μακεδονίας',
    'Δυτικής Μακεδονίας',
    'Ανατολικής Μακεδονίας και Θράκης',
    'Ηπείρου',
    'Θεσσαλίας',
    'Ιονίων Νήσων',
    'Δυτικής Ελλάδας',
    'Πελοποννήσου',
    'Βορείου Αιγαίου',
    'Νοτίου Αιγαίου',
    'Κρήτης',
    'Εύβοιας',
    'Ευβοίας',
    'Αχαΐας',
    'Μαγνησίας',
    'Λάρισας',
    'Λαρίσης',
    'Κορινθίας',
    'Αρκαδίας',
    'Μεσσηνίας',
    'Λακωνίας',
    'Ηλείας',
    'Βοιωτίας',
    'Φθιώτιδας',
    'Φωκίδας',
    'Ευρυτανίας',
    'Αιτωλοακαρνανίας',
    'Άρτας',
    'Πρέβεζας',
    'Θεσπρωτίας',
    'Ιωαννίνων',
    'Τρικάλων',
    'Καρδίτσας',
    'Πιερίας',
    'Ημαθίας',
    'Πέλλας',
    'Κιλκίς',
    'Σερρών',
    'Χαλκιδικής',
    'Δράμας',
    'Καβάλας',
    'Ξάνθης',
    'Ροδόπης',
    'Έβρου',
)
