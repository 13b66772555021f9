"""budgetlens.functions"""
